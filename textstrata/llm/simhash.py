"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most ``k`` bits share at least ``8 - k`` of them, which is the guaranteed
minimum of the count filter.  A posting list of one byte would hold 1/256 of
all fingerprints and its pairs grow with the square, so the lists are
intersected before anything is tallied: one posting per combination of
``8 - k`` positions.  Two fingerprints meet in a posting exactly when their
tally of shared bytes reaches the minimum, and a posting can't hold more than
``256**k`` distinct fingerprints whatever the input looks like.  Inside a
posting the tally and the bit distance are verified, and only a forest of
links leaves it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.llm.components import components
from textstrata.llm.shared import materialise, parts, utf8

SEED = 42
#: Shingles hashed at once; bounds the memory of a very long text.
SLICE = 1 << 16
#: Postings up to this size compare their members directly; larger ones look up
#: the fingerprints at each allowed bit change.  Both find the same links.
DIRECT = 200


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit integer.

    A-Z are lower-cased; shingles of ``shingle`` words, repeats included, are
    hashed with XXH64 (seed 42); a bit is set if more than half of the hashes
    have it.  With fewer words the whole sequence is the one shingle; a null
    text or one without words has fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, SLICE):
        part = words[a:min(n, a + SLICE) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for each row, ``fp`` as a signed long; row-local."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _near(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct fingerprints that are at most ``k`` bits apart."""
    if len(fps) <= DIRECT:
        diff = fps[:, None] ^ fps[None, :]
        tally = (diff[..., None].view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(axis=2)
        i, j = np.nonzero((tally >= 8 - k) & (np.bitwise_count(diff) <= k))
        keep = i < j
        return i[keep], j[keep]
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << b for b in range(64) if free >> b & 1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, k + 1):
        for flips in combinations(bits, n):
            other = fps ^ np.uint64(sum(flips))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            i = np.nonzero((fps[at] == other) & (other > fps))[0]
            if len(i):
                found.append((i, at[i]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _forest(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a posting with the smallest one it is linked to inside it."""
    i, j = _near(fps, k)
    root = np.arange(len(fps))
    while len(i):
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
    own = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[own], fps[root[own]]


def _links(k: int):
    """Postings, sorted by (combination, shared bytes, fingerprint), to links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        for last, b in _with_last(batches):
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, b.columns)] if b is not None else rest
            new = np.nonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))[0] + 1
            cuts = np.concatenate([[0], new, [len(cols[0])]])
            done = len(cuts) - 1 if last else len(cuts) - 2  # the last posting may go on in the next batch
            starts, ends = cuts[:done], cuts[1:done + 1]
            u, v = [], []
            for a, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                x, y = _forest(np.unique(cols[2][a:e].view(np.uint64)), k)
                u.append(x)
                v.append(y)
            rest = [c[cuts[done]:] for c in cols]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])
    return run


def _with_last(batches):
    for b in batches:
        yield False, b
    yield True, None


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints at most ``max_bits`` apart.

    ``distinct`` holds each fingerprint once, in ``fp``.  The result keeps
    every connection (a spanning forest per posting), not every pair.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3: a posting of 8 - max_bits shared bytes has to stay bounded")
    masks = [sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 8 - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posting = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)]))
    index = distinct.select(posting.alias("p"), "fp").select("p.combo", "p.shared", "fp")
    return index.repartition("combo", "shared").sortWithinPartitions("combo", "shared", "fp").mapInArrow(_links(max_bits), "u long, v long")


def _named_groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, group, component_id)`` for each fingerprint of a written ``(id, fp)`` table.

    ``group`` is a fingerprint of the group, ``component_id`` its smallest id.
    """
    first = materialise(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = materialise(components(materialise(links(first, max_bits), "links")), "roots")
    # fingerprints without a link are their own group and skip the second aggregation
    linked = first.join(roots, first.fp == roots.node).select("fp", "low", "root")
    low = linked.groupBy("root").agg(F.min("low").alias("group_low"))
    named = linked.join(low, "root").select("fp", "root", "group_low")
    return first.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("group_low", "low").alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` per input row.

    ``component_id`` is the smallest id among all rows reachable over links of
    at most ``max_bits`` differing bits, the row itself included.  Rows without
    words have fingerprint zero and are linked like any other.  Repeated rows
    each get a row; rows with one id and different texts link their groups only
    if the fingerprints do.  A null id takes part with its text, but never
    names a group: a group of null ids only has a null ``component_id``.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return fps.join(_named_groups(fps, max_bits), "fp").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, all columns.

    Exactly one row of each group stays: the one with the smallest id, null
    ids last, then the smallest text.  Rows that repeat an id are rows of their
    own; with texts of different groups each can stay for its group.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    # the rows are numbered once, in a written table, so that the numbers hold for every later read
    rows = materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["row", "id", "fp"])

    src = rows.select(F.col(name).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fps = materialise(src.mapInArrow(run, "row long, id long, fp long"), "fingerprints")
    # only rows that have the id of their group can stay; most groups have one such row
    able = fps.join(_named_groups(fps, max_bits), "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).select("row", "group")
    able = materialise(able, "rows-of-smallest-id")
    first = materialise(able.groupBy("group").agg(F.min("row").alias("row"), F.count("*").alias("n")), "first-rows")
    tied = able.join(first.where("n > 1").select("group"), "group").select("row", "group")
    texts = tied.join(src.select("row", "text"), "row")
    least = texts.groupBy("group").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text", "row")).alias("m")).select("m.row")
    keep = first.where("n = 1").select("row").union(least).select(F.col("row").alias("_kept_row"))
    return rows.join(keep, rows[name] == keep["_kept_row"], "left_semi").drop(name)
