"""Scoring texts with a hashed maximum-entropy language model.

Tokens are words and one end per text.  The ``HEAD`` most frequent words are
outputs of their own, all others share outputs by the hash of their last bytes.
A token's probability is P(class | context) P(output | class, context)
P(word | output): two softmax layers over hashed n-gram and skip features of
the three tokens before it, and smoothed counts inside an output.

The features are made of the words themselves: a word of the bounded table by its
rank, any other by a hash of all its bytes.  Training is one pass in numpy batches:
every update is a distributed sum of the gradient over its own part of the
texts, and each text belongs to one update.
Word counts cover the whole corpus and stay distributed: a bounded table of the
most frequent words is looked up in place, all other words are joined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, parts

END = b""  # the end of a text; no word is empty
HEAD, TAILS, WIDTH = 512, 512, 32  # outputs of one word, of hashed endings; members of a class
OUTPUTS = HEAD + TAILS
CLASSES = OUTPUTS // WIDTH
ROWS = 1 << 14  # weight rows that features are hashed to, a power of two
#: Words looked up in place: at most so many, each of at most so many bytes.
LOOKUP, LOOKUP_BYTES = 131_072, 64
#: Codes of all other words: the hashed ending, and so many hashes of the whole word for each.
SPREAD = 128
HASHED = TAILS * SPREAD
#: The word one, two and three places back, as features see it: words of their own, then hashed ones.
NEAR = MIDDLE = FAR = (LOOKUP, HASHED)
#: Tokens whose weights are looked up at a time, and tokens whose slopes are summed at a time.
SLICE, SUMMED = 2_000, 32_000
#: Distinct words a task counts before it passes them on, and words whose output a task remembers.
HELD = 1 << 18
UPDATES, RATE, PRIOR = 30, 0.3, 1.0
#: At most so many tasks send the driver a gradient at once.
PARTS = 16


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:])


def lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case; null: empty.  Arrow's own function mixes up the bytes of an array that is a slice of another."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    _, places, data = whole.buffers()
    at = np.frombuffer(places, np.int64, len(whole) + 1, whole.offset * 8) if len(whole) else np.zeros(1, np.int64)
    data = data.slice(at[0], at[-1] - at[0]).to_pybytes().lower() if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(at - at[0]), pa.py_buffer(data))


def byte_strings(array: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls; many times faster than one Arrow scalar a value."""
    _, places, data = array.buffers()
    at = np.frombuffer(places, np.int64, len(array) + 1, array.offset * 8).tolist() if len(array) else []
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(at, at[1:])]


class Tokens:
    """The tokens of texts, each text's words with A-Z in lower case and one end; null: no words.

    ``kinds`` are the distinct tokens as bytes, the end first, ``at`` the place of each token in
    them; ``starts`` are the places where texts begin, ``plain`` the texts' words with one blank between.
    """

    def __init__(self, texts: pa.Array):
        lower = pc.ascii_trim_whitespace(lowered(texts))
        # Arrow's blanks are space, tab, line feed, VT, FF and CR; of a text without words it makes one empty string
        words = pc.ascii_split_whitespace(lower)
        self.plain = pc.binary_join(words, pa.scalar(" ", pa.large_string()))
        flat = words.flatten().cast(pa.large_binary())
        coded = flat.dictionary_encode()
        self.kinds = pa.concat_arrays([pa.array([END], pa.large_binary()), coded.dictionary])
        count, some = len(texts), pc.binary_length(lower).to_numpy(zero_copy_only=False) > 0
        lengths = np.where(some, pc.list_value_length(words).to_numpy(zero_copy_only=False), 0) + 1
        ends = np.cumsum(lengths)
        self.starts, self.lengths = ends - lengths, lengths
        self.at = np.zeros(int(ends[-1]) if count else 0, np.int64)
        word = np.ones(len(self.at), bool)
        word[ends - 1] = False
        self.at[word] = coded.indices.to_numpy(zero_copy_only=False)[pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0] + 1


def token_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Texts of at most about ``limit`` bytes at a time: (their rows, their tokens)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, "right")))
            part = b.slice(first, last - first)
            yield part, Tokens(part.column(column))
            first = last


# ------------------------------------------------ counts

def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)``: how often each token occurs in the one text column of ``texts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])

        for _, some in token_batches(batches, 0):
            held.append(pa.table({"word": some.kinds.cast(pa.binary()), "c": pa.array(np.bincount(some.at, minlength=len(some.kinds)), pa.int64())}))
            if sum(map(len, held)) >= 2 * HELD:
                held = [summed()]
                if len(held[0]) >= HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task needs to know of the word counts: a bounded table.

    ``common`` are the most frequent words with their counts, in that order (the
    end is first), ``tokens`` and ``kinds`` the corpus totals, ``tail_counts`` and
    ``tail_kinds`` the totals of the words behind each hashed output.
    """

    def __init__(self, common: list[tuple[bytes, int]], tokens: int, kinds: int, tail_counts: np.ndarray, tail_kinds: np.ndarray, lookup: int = LOOKUP):
        self.lookup = lookup
        self.ranks = {w: i for i, (w, _) in enumerate(common)}
        self.tokens, self.kinds = tokens, kinds
        self.counts = np.array([c for _, c in common], np.float64)
        self.tail_counts, self.tail_kinds = tail_counts, tail_kinds
        tail = np.array([ending(w) % TAILS for w, _ in common], np.int64)
        rank = np.arange(len(common))
        #: by code (rank, or lookup + hashes): the output, and the word as the three contexts see it
        self.output = np.concatenate([np.where(rank < HEAD, rank, HEAD + tail), np.zeros(lookup - len(common), np.int64), HEAD + np.arange(HASHED) % TAILS])
        code = np.arange(lookup + HASHED)
        self.context = [np.where(code < lookup, code, LOOKUP + code - lookup)] * 3
        totals = np.bincount(self.output[:len(common)], self.counts, OUTPUTS)[:HEAD]
        self.output_counts = np.concatenate([totals, tail_counts])
        order = np.argsort(-self.output_counts, kind="stable")
        place = np.empty(OUTPUTS, np.int64)
        place[order] = np.arange(OUTPUTS)
        self.cls, self.member = place // WIDTH, place % WIDTH

    def codes(self) -> Codes:
        return Codes(self.ranks, self.lookup)


class Codes(dict):
    """word -> rank, or ``lookup`` + hashes of its ending and of the whole word; remembers short words up to a bound."""

    def __init__(self, ranks: dict[bytes, int], lookup: int):
        super().__init__(ranks)
        self.ranks, self.lookup, self.words = ranks, lookup, None

    def hashed(self, word: bytes) -> int:
        return self.lookup + zlib.crc32(word[-3:]) % TAILS + TAILS * ((zlib.crc32(word) >> 16) % SPREAD)

    def __missing__(self, word: bytes) -> int:
        code = self.hashed(word)
        if len(word) <= LOOKUP_BYTES:
            if len(self) > len(self.ranks) + HELD:
                self.clear()
                self.update(self.ranks)
            self[word] = code
        return code

    def of(self, tokens: Tokens) -> np.ndarray:
        """The code of each token; every distinct one is looked up once."""
        if self.words is None:
            self.words = pa.array(self.ranks, pa.large_binary())
        codes = pc.index_in(tokens.kinds, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        other = np.flatnonzero(codes < 0)
        codes[other] = [self.hashed(w) for w in byte_strings(tokens.kinds.take(pa.array(other)))]
        return codes[tokens.at]


def vocabulary(counts: DataFrame, lookup: int = LOOKUP) -> Vocabulary:
    """The bounded table of a whole ``(word, c)`` table: ``lookup`` words of at most
    ``LOOKUP_BYTES`` bytes, the most frequent first (ties: smaller word), after the end."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    most = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= LOOKUP_BYTES)).orderBy(F.desc("c"), "word").limit(lookup - 1).toArrow()
    common = [(END, totals[2]), *zip(most.column("word").to_pylist(), most.column("c").to_pylist())]
    own = frozenset(w for w, _ in common[:HEAD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for b in batches:
            for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if word not in own:
                    tokens[ending(word) % TAILS] += c
                    kinds[ending(word) % TAILS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(TAILS), pa.int32()), pa.array(tokens), pa.array(kinds)], names=["tail", "c", "k"])

    tail_counts, tail_kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.select("word", "c").mapInArrow(run, "tail int, c long, k long").groupBy("tail").agg(F.sum("c").alias("c"), F.sum("k").alias("k")).collect():
        tail_counts[r["tail"]], tail_kinds[r["tail"]] = r["c"], r["k"]
    return Vocabulary(common, totals[0], totals[1], tail_counts, tail_kinds, lookup)


# ------------------------------------------------ contexts and features

def contexts(words: np.ndarray, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of concatenated texts: the class layer's context, the member layer's, class and member.

    ``words`` are the tokens as contexts see them, ``places`` their class and member
    as one number; ``starts`` are the places where texts begin, before them stands the end, word 0.
    """
    before = []
    for back in (1, 2, 3):
        w = np.zeros(len(words), np.int64)
        w[back:] = words[:-back]
        for k in range(back):
            at = starts + k
            w[at[at < len(words)]] = 0
            # a text shorter than k rows lets this touch the next one's first rows, which are its start as well
        before.append(w)
    near, middle, far = before
    cls, member = np.divmod(places.astype(np.int64), WIDTH)
    return (near * sum(MIDDLE) + middle) * sum(FAR) + far, (cls * sum(NEAR) + near) * sum(FAR) + middle, cls, member


def feature_rows(layer: int, context: np.ndarray) -> np.ndarray:
    """The hashed weight rows of contexts: words one, two and three back, n-grams and skip pairs of them.

    Returns (contexts, features); the member layer's features all hold the class.
    """
    if layer == 0:
        near, rest = np.divmod(context, sum(MIDDLE) * sum(FAR))
        middle, far = np.divmod(rest, sum(FAR))
        parts = [(0,), (1, near), (2, middle), (3, far), (4, near, middle), (5, near, far), (6, middle, far), (7, near, middle, far)]
    else:
        cls, rest = np.divmod(context, sum(NEAR) * sum(FAR))
        near, second = np.divmod(rest, sum(FAR))
        parts = [(8, cls), (9, cls, near), (10, cls, second), (11, cls, near, second)]
    out = np.empty((len(context), len(parts)), np.int64, order="F")
    for k, (template, *values) in enumerate(parts):
        h = np.full(len(context), template, np.uint64)
        for v in values:
            h = (h * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (h ^ (h >> np.uint64(29))) & np.uint64(ROWS - 1)
    return out


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A row per choice, a column per context: the sums of its weight rows, less the largest of the column."""
    total = np.take(weights, rows[:, 0], axis=0)
    one = np.empty_like(total)
    for k in range(1, rows.shape[1]):
        total += np.take(weights, rows[:, k], axis=0, out=one, mode="clip")  # all rows exist; other modes copy once more
    out = np.ascontiguousarray(total.T)  # maxima and sums along long rows are far faster
    out -= out.max(axis=0)
    return out


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the ``WIDTH`` choices in each context, from its weight rows."""
    out = logits(weights, rows)
    out -= np.log(np.exp(out).sum(axis=0))
    return out.T


# ------------------------------------------------ training

def context_cells(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(share, words, places)``: every text as its features see it, a row per text.

    ``words`` holds the context word of each token (int), ``places`` its class and
    member as one number (short); ``share`` is a hash of the text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        seen, place = vocab.context[0].astype("<i4"), (vocab.cls * WIDTH + vocab.member)[vocab.output].astype("<i2")

        def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
            offsets = np.append(starts, len(values)).astype(np.int32) * np.int32(values.itemsize)
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

        codes_of = vocab.codes()
        for _, some in token_batches(batches, 0):
            codes = codes_of.of(some)
            share = [zlib.crc32(b" ", zlib.crc32(text)) if text else 0 for text in byte_strings(some.plain.cast(pa.large_binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.int64()), lists(seen[codes], some.starts), lists(place[codes], some.starts)], names=["share", "words", "places"])

    return texts.mapInArrow(run, "share long, words binary, places binary")


def _token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of ``context_cells`` as (words, places, starts), short texts joined to ``SUMMED`` tokens or more at a time."""
    words, places, size = [], [], 0

    def block():
        lengths = np.array([len(x) // 2 for x in places], np.int64)
        return np.frombuffer(b"".join(words), "<i4"), np.frombuffer(b"".join(places), "<i2"), np.cumsum(lengths) - lengths

    for b in parts(batches):
        words += b.column(1).to_pylist()
        places += b.column(2).to_pylist()
        size += sum(len(x) // 2 for x in places[len(places) - b.num_rows:])
        if size >= SUMMED:
            yield block()
            words, places, size = [], [], 0
    if size:
        yield block()


def gradient(cells: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Observed minus expected counts of every weight, and the log likelihood, summed over all tokens."""
    shared = cells.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        slope, fit = np.zeros((WIDTH, ROWS)), 0.0
        for words, places, starts in _token_blocks(batches):
            one, two, cls, member = contexts(words, places, starts)
            for at in range(0, len(words), SUMMED):
                for layer, (context, choice) in enumerate(((one, cls), (two, member))):
                    rows, own = feature_rows(layer, context[at:at + SUMMED]), choice[at:at + SUMMED]
                    off, every = np.empty((WIDTH, len(own))), np.arange(len(own))
                    for k in range(0, len(own), SLICE):
                        z, some = logits(weights, rows[k:k + SLICE]), own[k:k + SLICE]
                        p = np.exp(z)
                        total = p.sum(axis=0)
                        fit += float((z[some, every[:len(some)]] - np.log(total)).sum(dtype=np.float64))
                        np.divide(p, -total, out=off[:, k:k + SLICE])
                    off[own, every] += 1
                    slope[:, rows[0, 0]] += off.sum(axis=1) if layer == 0 else 0.0  # the first feature of the class layer is one row, its intercept
                    for j in range(WIDTH):  # np.add.at is many times slower where an array's type was unpickled, as in tasks
                        for k in range(1 - layer, rows.shape[1]):
                            slope[j] += np.bincount(rows[:, k], off[j], ROWS)
        slope = slope.T
        at = np.flatnonzero(slope.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()]), pa.array([slope[at].astype("<f4").tobytes()]), pa.array([fit])], names=["at", "slope", "fit"])

    slope, fit = np.zeros((ROWS, WIDTH)), 0.0
    for r in cells.mapInArrow(run, "at binary, slope binary, fit double").collect():  # a row per task that has tokens, its weights with a slope
        slope[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["slope"], "<f4").reshape(-1, WIDTH)
        fit += r["fit"]
    shared.destroy()
    return slope, fit


def train(cells: DataFrame, updates: int = UPDATES) -> np.ndarray:
    """Weights after ``updates`` gradient updates, which share all texts among them.

    Each update is one job over its own texts, as many tasks as there are cores
    (``PARTS`` at most), with a Gaussian prior and a step per weight that shrinks
    with its past slopes.  No texts: zeros.
    """
    tasks = min(cells.sparkSession.sparkContext.defaultParallelism, PARTS)
    dealt = cells.select("share", "words", "places", F.pmod("share", F.lit(updates)).cast("int").alias("turn"))
    spread = materialise(dealt.repartition(updates * tasks, "turn", F.floor(F.col("share") / updates) % tasks), "cells", "turn")
    weights, past = np.zeros((ROWS, WIDTH)), np.zeros((ROWS, WIDTH))
    for turn in range(updates):
        slope, _ = gradient(spread.where(F.col("turn") == turn).coalesce(tasks), weights.astype(np.float32))
        slope -= PRIOR / updates * weights
        past += slope * slope
        weights += RATE * slope / np.sqrt(past + 1.0)
    return weights.astype(np.float32)


# ------------------------------------------------ scores

def _in_place(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Per row everything but the counts of words outside the bounded table.

    ``(id, row, n_tokens, known, base, model, rare)``: sums of log10 over the
    tokens, with the words outside the table left as ``rare`` (word, times).
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    schema = "id long, row long, n_tokens long, known long, base double, model double, rare array<struct<word:binary,times:long>>"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    names = ["id", "row", "n_tokens", "known", "base", "model", "rare"]

    def outside(some: Tokens, codes: np.ndarray, lookup: int) -> pa.Array:
        """(word, times) of the words outside the bounded table, a list per text."""
        at = np.flatnonzero(codes >= lookup)
        pairs, times = np.unique((np.searchsorted(some.starts, at, "right") - 1) * len(some.kinds) + some.at[at], return_counts=True)
        text, kind = np.divmod(pairs, len(some.kinds))
        words = some.kinds.take(pa.array(kind)).cast(pa.binary())
        offsets = np.searchsorted(text, np.arange(len(some.starts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, pa.array(times.astype(np.int64))], names=["word", "times"])).cast(rare_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = shared.value
        codes_of = vocab.codes()
        place = vocab.cls * WIDTH + vocab.member

        def layer(k: int, context: np.ndarray, choice: np.ndarray) -> np.ndarray:
            out = np.empty(len(context))
            for at in range(0, len(context), SLICE):
                own = choice[at:at + SLICE]
                z = logits(weights, feature_rows(k, context[at:at + SLICE]))
                chosen = z[own, np.arange(len(own))]
                out[at:at + SLICE] = chosen - np.log(np.exp(z, out=z).sum(axis=0))
            return out

        counts = np.concatenate([vocab.counts, np.zeros(vocab.lookup + HASHED - len(vocab.counts))])
        all_log = math.log10(vocab.tokens + 0.5 * (vocab.kinds + 1))
        base_of = np.log10(counts + 0.5) - all_log  # of a word outside the table: its share without its count
        base_of[vocab.lookup:] = -all_log
        inside = np.log10(counts + 0.5)
        inside[vocab.lookup:] = 0.0
        output = vocab.output
        tail = np.maximum(output - HEAD, 0)
        inside -= np.log10(vocab.tail_counts + 0.5 * (vocab.tail_kinds + 1))[tail]
        inside[output < HEAD] = 0.0
        for part, some in token_batches(batches, 2):
            codes, starts = codes_of.of(some), some.starts
            one, two, cls, member = contexts(vocab.context[0][codes], place[output[codes]], starts)
            model = (layer(0, one, cls) + layer(1, two, member)) / math.log(10.0) + inside[codes]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(some.lengths.astype(np.int64)), pa.array(np.add.reduceat((counts[codes] > 0).astype(np.int64), starts)),
                 pa.array(np.add.reduceat(base_of[codes], starts)), pa.array(np.add.reduceat(model.astype(np.float64), starts)), outside(some, codes, vocab.lookup)], names=names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``counts`` are the whole corpus's word counts.  Words outside the bounded
    table are rare, so the join that fetches their counts has no frequent key.
    Null and empty texts have one token, the end; repeated rows are scored one by
    one; an empty table gives an empty table.  Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(_in_place(src, vocab, weights), "scored-in-place")
    pairs = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = pairs.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("gain"))
    unseen = F.aggregate("rare", F.lit(0).cast("long"), lambda n, r: n + r["times"]) * F.log10(F.lit(0.5))
    lean = rows.select("id", "row", "n_tokens", "known", (F.col("base") + unseen).alias("base"), (F.col("model") + unseen).alias("model"))
    return lean.join(found, "row", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def fit_and_score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of every row of ``docs`` with counts and weights learned from all rows of ``training``.

    Without training rows nothing is known: the base score is zero a token, the model uniform.
    """
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    counts = materialise(count_words(texts), "word-counts")
    vocab = vocabulary(counts)
    weights = train(context_cells(texts, vocab))
    return score(docs, counts, vocab, weights, id_col, text_col)
