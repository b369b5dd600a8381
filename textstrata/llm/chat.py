"""Chat formatting by columnar byte assembly.

A batch of turns is formatted without touching its texts one by one: segment
lengths give cumulative offsets, offsets give scatter indices, and headers,
contents and trailers are copied into one preallocated buffer that becomes an
Arrow string column.  Formatting is row-local, so one huge conversation doesn't
gather in a task; a conversation's text is its segments in order of ``turn``.

Template, one segment per turn:
``<s>[INST] user text [/INST]``, ``<s> assistant text </s>``,
``<s><<SYS>> system text <</SYS>>``, ``<s>[ROLE] other role [/ROLE] text </s>``.
Inside texts a backslash is doubled and a control string gets a backslash after
its first character, so no control string remains and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}
TURN = re.compile(r"<s>(?:\[INST\] (?P<user>.*) \[/INST\]|<<SYS>> (?P<system>.*) <</SYS>>|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*) </s>| (?P<assistant>.*) </s>)", re.S)
#: Texts are assembled in runs of rows of about so many bytes; the index arrays take some 20 bytes for each.
RUN_BYTES = 4 << 20
BACKSLASH = ord("\\")


def _marks(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where an escaping backslash follows the byte; ``ends``: the end of each byte's row."""
    marks = data == BACKSLASH
    for control in CONTROLS:
        c = control.encode()
        if len(data) < len(c):
            continue
        hit = data[:len(data) - len(c) + 1] == c[0]
        for i in range(1, len(c)):
            hit &= data[i:len(data) - len(c) + 1 + i] == c[i]
        at = np.nonzero(hit)[0]
        marks[at[at + len(c) <= ends[at]]] = True
    return marks


def escape(text: str) -> str:
    """The escaped form of one text, by the same rule as the columnar form."""
    data = np.frombuffer(text.encode(), np.uint8)
    marks = _marks(data, np.full(len(data), len(data)))
    out = np.repeat(data, marks + 1)
    at = np.nonzero(marks)[0]
    out[at + np.arange(1, len(at) + 1)] = BACKSLASH
    return out.tobytes().decode()


def unescape(text: str) -> str:
    """Undoes ``escape``: a doubled backslash is one, any other is dropped."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def frame_of(role: str) -> tuple[str, str]:
    return FRAMES.get(role) or (f"<s>[ROLE] {escape(role)} [/ROLE] ", " </s>")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted segments, and the start and end of each content in code points."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    coded = pc.fill_null(roles.cast(pa.string()), "").dictionary_encode()
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    frames = [frame_of(r) for r in coded.dictionary.to_pylist()]
    heads, tails = ([f[side].encode() for f in frames] for side in (0, 1))
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    source = texts.buffers()[2]
    data = np.frombuffer(source, np.uint8)[offsets[0]:offsets[-1]] if source is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    marks = _marks(data, np.repeat(offsets[1:], lengths))
    before = np.concatenate([[0], np.cumsum(marks)])
    head = np.array([len(h) for h in heads], np.int64)[kind]
    tail = np.array([len(t) for t in tails], np.int64)[kind]
    inner = lengths + before[offsets[1:]] - before[offsets[:-1]]
    out_at = np.concatenate([[0], np.cumsum(head + inner + tail)])
    out = np.empty(out_at[-1], np.uint8)
    for k, (h, t) in enumerate(zip(heads, tails)):
        rows = np.nonzero(kind == k)[0]
        out[out_at[rows][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
        out[(out_at[rows + 1] - len(t))[:, None] + np.arange(len(t))] = np.frombuffer(t, np.uint8)
    at = np.arange(len(data)) + before[:-1] + np.repeat(out_at[:-1] + head - offsets[:-1] - before[offsets[:-1]], lengths)
    out[at] = data
    out[at[marks] + 1] = BACKSLASH
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points start at all other bytes
    start = np.array([len(h.decode()) for h in heads], np.int64)[kind]
    end = start + points[offsets[1:]] - points[offsets[:-1]] + inner - lengths
    array = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(out_at.astype(np.int64)), pa.py_buffer(out)])
    return array.cast(pa.string()), start, end


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + RUN_BYTES, side="right")))
        yield at, end
        at = end


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, segment, loss_start, loss_end)``: one formatted segment per row.

    ``loss_start`` and ``loss_end`` bound an assistant's text inside the segment
    in code points, and are null for other roles.  Null texts and roles count
    as empty; unknown roles are named in the segment.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e in _runs(b.column(3)):
                part = b.slice(a, e - a)
                segments, start, end = assemble(part.column(2), part.column(3))
                own = pc.fill_null(pc.equal(part.column(2).cast(pa.string()), "assistant"), False)
                bound = lambda x: pc.if_else(own, pa.array(x, pa.int64()), pa.scalar(None, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), segments, bound(start), bound(end)], names=["conv_id", "turn", "segment", "loss_start", "loss_end"])

    src = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "conv_id long, turn long, segment string, loss_start long, loss_end long")


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = TURN.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    if m["role"] is not None:
        return unescape(m["role"]), unescape(m["other"])
    role = next(r for r in FRAMES if m[r] is not None)
    return role, unescape(m[role])


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turn_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        role, text = parse_segment(segment)
        self.turns += 1
        self.chars += len(segment)
        self.turn_sha.update(f"{role}\n{text}\n".encode())
        if start is not None:
            loss = unescape(segment[start:end])
            self.loss_chars += len(loss)
            self.loss_sha.update(loss.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turn_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation: turns, digests of the turns and of the text under the loss mask, code points.

    The segments of a conversation, ordered by turn (ties by segment), stream
    through running digests, so a conversation of any size takes constant
    memory.  A null ``conv_id`` is one conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done = []
            for conv, segment, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(segment, start, end)
            if done:
                yield _rows(done, names)
        if now is not None:
            yield _rows([now.row()], names)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def conversations(segments: DataFrame) -> DataFrame:
    """``(conv_id, text)``: whole formatted conversations, for consumers that need one string each."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(ordered["segment"], "").alias("text"))
