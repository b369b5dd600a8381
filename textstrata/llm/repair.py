"""Conversation structure repair by cheapest edits on a suffix-shared automaton.

Every row of a conversation becomes one symbol (role initial and first fault),
a conversation the string of its symbols.  Equal strings are solved once for
all conversations.  The distinct strings are read in the order of their
reverses, so those with a common ending follow each other: the node of each
suffix is made once, from the node of the suffix one symbol shorter, and holds
the cost to go and the first edit of the best audit for every state of the
role grammar ``(s?(ua)+)?``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, utf8

#: States: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row: a user, or after a user an assistant.
FORCED = (USER, USER, ASSISTANT, USER)
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
INITIALS = "sua"
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
SPACE = " \t\n\x0b\x0c\r"
FIELDS = ("blank", "duplicate", "truncated", "illegal", "cost")


class Node(NamedTuple):
    """One suffix: per grammar state the cost to go and the first edit of the
    ASCII-least cheapest audit ("" where it ends); its faults and illegal pairs."""

    cost: tuple[int, ...]
    edit: tuple[str, ...]
    role: int
    faults: tuple[int, ...]
    illegal: int


#: The empty suffix: a conversation may end at the start or after an assistant.
END = Node((0, 4, 2, 0), ("", "I", "I", ""), -1, (0, 0, 0, 0), 0)


def kept_state(role: int, state: int) -> int | None:
    """The state after keeping a row of this role (0 s, 1 u, 2 a, 3 other), if the grammar lets it stand."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def extend(symbol: int, rest: Node) -> Node:
    """The node of the suffix ``symbol`` + the suffix of ``rest``.

    From one state every letter leads to one place, so the least audit among the
    cheapest takes the least letter that keeps the least cost.
    """
    role, fault = divmod(symbol, 4)
    late = int(fault == TRUNCATED)
    cost, edit = [0] * 4, [""] * 4
    for state in range(4):
        choices = [(3 + rest.cost[state], "D")]
        if fault in (CLEAN, TRUNCATED):
            then = kept_state(role, state)
            if then is not None:
                choices.append((late + rest.cost[then], "K"))
            choices.append((2 + late + rest.cost[FORCED[state]], "R"))
        cost[state], edit[state] = min(choices)
    for _ in range(3):  # inserted rows change the state only, and at most three in a row can help
        for state in range(4):
            cost[state], edit[state] = min((cost[state], edit[state]), (2 + cost[FORCED[state]], "I"))
    faults = tuple(n + (i == fault) for i, n in enumerate(rest.faults))
    return Node(tuple(cost), tuple(edit), role, faults, rest.illegal + (rest.role >= 0 and (role, rest.role) not in LEGAL_PAIRS))


def walk(path: list[Node]) -> Iterator[tuple[str, int]]:
    """The edits of the best audit from the start, with the state after each; ``path[k]`` is the suffix of k symbols."""
    state, k = START, len(path) - 1
    while path[k].edit[state]:
        letter = path[k].edit[state]
        if letter in "IR":
            state = FORCED[state]
        elif letter == "K":
            state = kept_state(path[k].role, state)
        k -= letter != "I"
        yield letter, state


def solve_sorted(signatures: Iterator[str]) -> Iterator[tuple[str, str, Node]]:
    """``(signature, audit, node)`` of signatures that come in the order of their reverses.

    Only the path of the present signature is held; the nodes it shares with the
    one before stay.
    """
    path, before = [END], ""
    for signature in signatures:
        reverse = signature[::-1]
        del path[len(os.path.commonprefix([before, reverse])) + 1:]
        for symbol in reverse[len(path) - 1:]:
            path.append(extend(ord(symbol) - 65, path[-1]))
        before = reverse
        yield signature, "".join(letter for letter, _ in walk(path)), path[-1]


def _prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


ORDER = (F.asc_nulls_first, "conv"), (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv, signature, gaps)`` of prepared rows; texts stay behind.

    One shuffle by conversation serves the search for repeats and the string.
    Rows of one turn are ordered by role, then by the digest of role and text.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    role = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    # instr finds the empty text at 1: an empty role has no initial
    role = F.when((F.length("role") == 0) | (role == 0), 3).otherwise(role - 1)
    lean = rows.select("conv", "turn", "role", "digest", (role * 4).alias("_code"), (last == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_cut"))
    lean = lean.repartition("conv").withColumn("_n", F.expr("row_number() OVER (PARTITION BY conv, digest ORDER BY turn NULLS FIRST)"))
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_n") > 1, DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(CLEAN)
    coded = lean.sortWithinPartitions(*[f(c) for f, c in ORDER]).select("conv", "turn", (F.col("_code") + fault).cast("int").alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # [conv, pieces of the string, least turn, greatest turn, distinct turns]
        done = []

        def close():
            done.append((now[0], b"".join(now[1]).decode(), 0 if now[2] is None else now[3] - now[2] + 1 - now[4]))

        for b in batches:
            conv, turn = b.column(0).to_pylist(), b.column(1).to_pylist()
            letters = (b.column(2).to_numpy(zero_copy_only=False) + 65).astype(np.uint8).tobytes()
            begin = 0
            for i in range(b.num_rows + 1):
                if i < b.num_rows and now is not None and conv[i] == now[0]:
                    t = turn[i]
                    if t is not None and t != now[3]:
                        now[2] = t if now[2] is None else now[2]
                        now[3], now[4] = t, now[4] + 1
                    continue
                if now is not None:
                    now[1].append(letters[begin:i])
                if i == b.num_rows:
                    break
                if now is not None:
                    close()
                begin, t = i, turn[i]
                now = [conv[i], [], t, t, int(t is not None)]
            yield from _flush(done)
        if now is not None:
            close()
        yield from _flush(done)

    def _flush(done):
        if done:
            conv, sig, gaps = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(sig, pa.string()), pa.array(gaps, pa.int64())], names=["conv", "signature", "gaps"])
            done.clear()

    return coded.mapInArrow(run, "conv long, signature string, gaps long")


def solve(distinct: DataFrame) -> DataFrame:
    """``(signature, audit, blank, duplicate, truncated, illegal, cost)`` of a table of distinct signatures.

    The reverses are cut into ranges: a suffix is a node in one task, but for the
    one path where two ranges meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (s for b in batches for s in b.column(0).to_pylist())
        rows = []
        for signature, audit, node in solve_sorted(every):
            rows.append((signature, audit, node.faults[BLANK], node.faults[DUPLICATE], node.faults[TRUNCATED], node.illegal, node.cost[START]))
            if len(rows) == 4096:
                yield _solved(rows)
                rows = []
        if rows:
            yield _solved(rows)

    def _solved(rows):
        columns = [pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(zip(*rows))]
        return pa.RecordBatch.from_arrays(columns, names=["signature", "audit", *FIELDS])

    sorted_ = distinct.select("signature", F.reverse("signature").alias("_r")).repartitionByRange("_r").sortWithinPartitions("_r")
    return sorted_.select("signature").mapInArrow(run, "signature string, audit string, " + ", ".join(f"{f} long" for f in FIELDS))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``: the digest of the repaired ``role:text`` lines.

    A conversation's audit and then its rows stream through one task in order;
    the task holds the audit and one batch of rows.
    """
    facts = ["gaps", *FIELDS]
    heads = audits.select("conv", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), *facts)
    lines = rows.select("conv", F.lit(1).alias("_kind"), "turn", "role", "digest", "text", *[F.lit(None).cast("long").alias(f) for f in facts])
    order = [F.asc_nulls_first("conv"), F.asc("_kind"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")]
    stream = heads.union(lines).repartition("conv").sortWithinPartitions(*order).select("conv", "_kind", "role", "text", *facts)
    names = ["conv", "audit", "repaired_sha256", *facts]

    class Repair:
        """The running digest of one conversation."""

        def __init__(self, conv, audit: bytes, values):
            self.conv, self.audit, self.values = conv, audit.decode(), values
            self.at, self.state, self.sha, self.empty = 0, START, hashlib.sha256(), True

        def line(self, role: bytes, text: bytes) -> None:
            self.sha.update((b"" if self.empty else b"\n") + role + b":" + text)
            self.empty = False

        def forced(self, text: bytes) -> None:
            self.state = FORCED[self.state]
            self.line(b"user" if self.state == USER else b"assistant", text)

        def inserts(self) -> None:
            while self.audit[self.at:self.at + 1] == "I":
                self.at += 1
                self.forced(b"")

        def row(self, role: bytes, text: bytes) -> None:
            self.inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = kept_state(INITIALS.index(role[:1].decode()), self.state)
                self.line(role, text)
            elif letter == "R":
                self.forced(text)

        def result(self):
            self.inserts()
            return (self.conv, self.audit, self.sha.hexdigest(), *self.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush():
            if done:
                columns = [pa.array(c, pa.string() if 0 < k < 3 else pa.int64()) for k, c in enumerate(zip(*done))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done.clear()

        for b in batches:
            conv, kind = b.column(0).to_pylist(), b.column(1).to_pylist()
            role, text = utf8(b.column(2)), utf8(b.column(3))
            values = [b.column(4 + k) for k in range(len(facts))]
            for i in range(b.num_rows):
                if kind[i] == 0:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(conv[i], text[i], [v[i].as_py() for v in values])
                else:
                    now.row(role[i], text[i])
            yield from flush()
        if now is not None:
            done.append(now.result())
        yield from flush()

    return stream.mapInArrow(run, "conv long, audit string, repaired_sha256 string, " + ", ".join(f"{f} long" for f in facts))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: faults, cheapest edits and the digest of the repaired rows.

    Returns ``(conv, audit, repaired_sha256, gaps, blank, duplicate, truncated,
    illegal, cost)``.  Rows stand in the order of their turns, nulls first; rows
    of one turn by role, then by the digest of role and text.  A null role or
    text is one space; an empty role has no initial, so its row can't be kept.
    Rows of a null conversation are one conversation.  Repeated rows are
    duplicates.  No rows give no conversations.  Other columns are ignored.

    Faults and strings need no texts; texts are shuffled once, for the digest,
    which the hash makes sequential within one conversation.  A task holds the
    string (a byte a row) of one conversation at a time.
    """
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col)
    strings = materialise(signatures(rows), "signatures")
    solved = solve(materialise(strings.select("signature").distinct(), "distinct-signatures"))
    audits = strings.join(solved, "signature").drop("signature")
    return repaired(rows, audits)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with seeded faults, for tests and queries: by the CRC-32 of
    ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), loses its
    ``[.!?]`` (2), is repeated (3) or becomes a user's (4).  Nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    out = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).when(kind == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return out.drop("_copy")
