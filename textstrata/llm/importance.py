"""Target-distribution importance resampling on hashed word n-grams.

Texts are cut by an untrained regex split of the ``tokenizers`` library, which
returns words with their offsets.  Windows of one to three consecutive offset
pairs are the features; their CRC-32 buckets are counted over the raw corpus
and over the target texts.  A bucket's gain is the log ratio of the two shares,
a document's weight the sum over its features, and a seeded Gumbel noise turns
"highest scores" into a draw without replacement by those weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, utf8
from textstrata.operators.prefix import running_sum

BUCKETS = 10_000
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of one Arrow batch that a task returns at a time.
SLICE = 512


def _splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD_PATTERN), behavior="removed", invert=True)


def window_crcs(lowered: str, pairs: list[tuple[int, int]]) -> list[int]:
    """CRC-32 of every run of one to three consecutive words, joined by one space.

    ``pairs`` are the words' offsets.  A longer window goes on from the CRC of
    the shorter one that starts at the same word, so each word is read three times.
    """
    words = [lowered[a:b].encode() for a, b in pairs]
    spaced = [b" " + w for w in words]
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, spaced[1:], one))
    return one + two + list(map(zlib.crc32, spaced[2:], two))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, n_features, buckets)`` per row; ``buckets`` holds one little-endian uint32 per feature.

    Row-local, whole texts; A-Z is lower-cased and nothing else.  Null and empty
    texts have no words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                words, packed = [], []
                for raw in utf8(part.column(1)):
                    lowered = (raw or b"").lower().decode("utf-8", "replace")
                    pairs = [p for _, p in split.pre_tokenize_str(lowered)]
                    words.append(len(pairs))
                    packed.append((np.array(window_crcs(lowered, pairs), "<u4") % np.uint32(buckets)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                    names=["id", "n_words", "n_features", "buckets"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, n_features long, buckets binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a binary column, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4"), np.array([len(x) // 4 for x in rows], np.int64)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features per bucket over all rows; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column(0))[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of every bucket, as int64.

    Both histograms have at most ``buckets`` rows; they reach the driver, as
    many numbers whatever the corpus.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, raw), (t, target)):
        for r in table.collect():
            counts[r["bucket"]] = r["n"]
    ratio = (t + 1.0) * (s.sum() + float(buckets)) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(id, n_words, n_features, weight)``: the sum of the gains of a row's features (none: 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, sizes = _numbers(b.column(3))
            sums = np.concatenate([[0], np.cumsum(gain[numbers])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums[ends] - sums[ends - sizes], pa.int64())],
                                             names=["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(id_: str = "id", seed: int = 42) -> Column:
    """``floor(-1000 ln(-ln((h+0.5)/2**32)))`` with ``h`` from the SHA-256 of ``seed:id`` (null id: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every row of ``docs``.

    Of the N rows with ``least_words`` words or more, the ``floor(per_cent N / 100)``
    with the highest scores get ranks 1, 2, 3 ..., ties to the smaller id (null
    last; rows of one id by n_features, then weight); all others a null rank.
    Null and empty texts have no features, weight 0 and no rank; repeated rows
    are drawn one by one; an empty corpus gives an empty table, an empty target
    leaves gains that only the corpus shapes.  Other columns are ignored.

    Each text is split once: its bucket numbers are written, the histograms and
    the weights read those.  Ranks are summed per range of the score order, so no
    task and no driver holds the rows.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(features(src, buckets=buckets), "ngram-buckets")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), buckets=buckets)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets), buckets)
    scored = materialise(weigh(found, gain).withColumn("score", F.col("weight") + noise("id", seed)), "scores")
    long_enough = scored.where(F.col("n_words") >= least_words)
    take = long_enough.count() * per_cent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    ranked = running_sum(long_enough, order, F.lit(1), "rank").withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("id", "n_features", "weight", "score", "rank")
