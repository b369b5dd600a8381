"""Packing into length buckets of least padding.

The lengths of all rows are counted in one histogram with a bin per distinct
length; a dynamic program over it chooses the bucket boundaries that minimise the
padding of every row to its boundary.  Inside a bucket, batches hold as many rows as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, word_count

#: Rows numbered by one task; a bucket is dealt over as many shards as this takes.
SHARD_ROWS = 20_000


def _layer(best: np.ndarray, top: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: the least padding of the first j lengths for every j, and where its last bucket begins.

    The best beginning never moves back as j grows, so the middle j is settled
    first and bounds the search on either side.
    """
    m = len(top)
    now, back = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    open_ = [(1, m, 0, m - 1)]
    while open_:
        low, high, first, last = open_.pop()
        if low > high:
            continue
        j = (low + high) // 2
        i = np.arange(first, min(last, j - 1) + 1)
        cost = best[i] + top[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
        at = int(cost.argmin())
        now[j], back[j] = cost[at], i[at]
        open_ += [(low, j - 1, first, i[at]), (j + 1, high, i[at], last)]
    return now, back


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the rising, distinct ``lengths`` as boundaries, with the least padding.

    ``counts`` rows have each length.  The last boundary is the longest length;
    ties go to fewer buckets.
    """
    m = len(lengths)
    if not m:
        return []
    top = np.array(lengths, dtype=np.float64)
    each = np.array(counts, dtype=np.float64)
    rows, tokens = (np.concatenate([[0.0], np.cumsum(x)]) for x in (each, each * top))
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    steps, ends = [], []
    for _ in range(min(buckets, m)):
        best, back = _layer(best, top, rows, tokens)
        steps.append(back)
        ends.append(best[m])
    layer = int(np.argmin(ends))
    out, j = [], m
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(steps[layer][j])
        layer -= 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16,
         token_budget: int = 16_384, seed: int = 7) -> DataFrame:
    """``(id, n_tokens, bucket, pad_to, batch, slot)`` per input row.

    ``length`` defaults to the number of words of the text; null counts 0.
    ``batch`` numbers the batches of a bucket from 0; each is full, with
    ``max(1, token_budget // pad_to)`` rows, but for a bucket's last one.  A row
    longer than the budget is alone in its batch, whole.  Rows stand in seeded
    order; repeated rows are rows of their own; an empty table gives an empty result.
    """
    n = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    # the histogram has a row per distinct length, two numbers each
    seen = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = seen.column("n_tokens").to_numpy(), seen.column("n").to_numpy()
    bounds = optimal_boundaries(lengths, counts, buckets)
    if not bounds:
        empty = F.lit(None)
        return rows.select("id", "n_tokens", empty.cast("int").alias("bucket"), empty.cast("long").alias("pad_to"), empty.cast("long").alias("batch"), empty.cast("long").alias("slot"))
    held = np.diff([0, *np.cumsum(counts)[np.searchsorted(lengths, bounds)]]).tolist()
    literal = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    at = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        at = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(at)
    dealt = rows.withColumn("bucket", at.cast("int")).withColumn("order", F.xxhash64("id", "row", F.lit(seed)))
    shards = literal([-(-h // SHARD_ROWS) for h in held])
    dealt = dealt.withColumn("shard", F.pmod("order", F.get(shards, F.col("bucket"))))
    # the numbers of earlier shards come from a table of one row per shard
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order", "row")) - 1)
    pad_to = F.get(literal(bounds), F.col("bucket"))
    room = F.get(literal([max(1, token_budget // max(1, b)) for b in bounds]), F.col("bucket"))
    place = F.col("first") + F.col("at")
    return (numbered.join(offsets, ["bucket", "shard"])
            .select("id", "n_tokens", "bucket", pad_to.alias("pad_to"), F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot")))
