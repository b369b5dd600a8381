"""Exact top-k inner products by pivot-table elimination.

A vector ``x`` with ``|x| <= M`` becomes ``x' = (x, sqrt(M^2 - |x|^2))`` and a
query becomes ``q' = (M q / |q|, 0)``; then ``|q' - x'|^2 = 2 M^2 - 2 M q.x / |q|``,
so the nearest neighbours of ``q'`` are the largest inner products.  Every
vector carries its distances to the pivots.  By the triangle inequality the
largest ``|d(q', p) - d(x', p)|`` over the pivots is a lower bound of the true
distance; candidates are evaluated in the order of that bound until it exceeds
the distance of the k-th best, which is exact.

Queries and candidates meet in blocks of a bounded number of rows, one task
group per (query block, candidate block); the k best of each block are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` without vectors that are null or hold null, NaN or infinity.

    Every other row stays, repeated ids too.  Null ids take no part.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~bad)


def _stack(values, dim: int) -> np.ndarray:
    """Rows of one width; shorter vectors are filled with zeros."""
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def _augmented(x: np.ndarray, radius: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(radius ** 2 - (x ** 2).sum(axis=1, keepdims=True), 0.0))])


def _query_points(q: np.ndarray, radius: float) -> np.ndarray:
    norm = np.sqrt((q ** 2).sum(axis=1, keepdims=True))
    scaled = np.divide(q * radius, norm, out=np.zeros_like(q), where=norm > 0)
    return np.hstack([scaled, np.zeros((len(q), 1))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(sq, 0.0))


def choose_pivots(sample: np.ndarray, radius: float, pivots: int) -> np.ndarray:
    """Farthest-first pivots among the augmented sample vectors."""
    points = _augmented(sample, radius)
    chosen = [0]
    near = _distances(points, points[:1])[:, 0]
    while len(chosen) < min(pivots, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def search_block(q_rows, q, q_table, x_rows, x, x_table, radius: float, k: int, x_ids=None) -> list[tuple[int, int, float]]:
    """The k best candidates of one block for each query of one block: ``(query row, id, score)``.

    Ties go to the smaller id; the query's own row is left out.  Ids default to row numbers.
    """
    x_ids = x_rows if x_ids is None else x_ids
    by_id = np.argsort(x_ids, kind="stable")
    x_ids, x_rows, x, x_table = x_ids[by_id], x_rows[by_id], x[by_id], x_table[by_id]
    out = []
    for qi in range(len(q_rows)):
        bound = np.zeros(len(x))
        for j in range(x_table.shape[1]):
            np.maximum(bound, np.abs(x_table[:, j] - q_table[qi, j]), out=bound)
        order = np.argsort(bound, kind="stable")
        norm = math.sqrt(float(q[qi] @ q[qi]))
        score, ids = np.empty(0), np.empty(0, np.int64)
        at, step = 0, 4 * k
        while at < len(order):
            if len(score) >= k:
                far = 2 * radius ** 2 - 2 * radius * score[k - 1] / norm if norm else radius ** 2
                if bound[order[at]] > math.sqrt(max(far, 0.0)) * (1 + 1e-9) + 1e-6:
                    break  # no later candidate can reach the k-th score
            part = order[at:at + step]
            part = part[x_rows[part] != q_rows[qi]]
            new = x[part] @ q[qi]
            if len(score) >= k or len(new) > k:  # scores below the k-th best so far are out before the sort; ties stay
                good = new >= (score[k - 1] if len(score) >= k else np.partition(new, -k)[-k])
                new, part = new[good], part[good]
            score, ids = np.concatenate([score, new]), np.concatenate([ids, x_ids[part]])
            best = np.lexsort((ids, -score))[:k]
            score, ids = score[best], ids[best]
            at, step = at + step, step * 2
        out += [(int(q_rows[qi]), int(i), float(s)) for i, s in zip(ids, score)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 16, candidate_block: int = 4096,
          query_block: int = 1024, pivot_sample: int = 1024) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest inner products of each query.

    ``vectors`` is ``(id, v array<double>)`` (``clean_vectors``); ``is_query`` marks
    the queries among them.  All rows but the query's own are candidates, fewer than
    ``k`` of them give fewer rows; where ids repeat, each row is a candidate and a
    query of its own.  Vectors of different
    lengths count as filled with zeros.  Scores are exact while products and sums
    stay below 2**53.  An empty table gives an empty result.  Pivots come from
    ``pivot_sample`` rows in hash order; they steer the speed, never the result.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("sq"), is_query.alias("is_query")), "vectors")
    n, nq, dim, sq = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v")), F.max("sq")).first()
    schema = "query_row long, query_id long, id long, score double"
    if not n or not nq:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "id", "score")
    dim, radius = max(1, dim), math.sqrt(sq) * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(pivot_sample).select("v").collect()
    chosen = choose_pivots(_stack([r.v for r in sample], dim), radius, pivots)

    def table(batches):
        for pdf in batches:
            x = _stack(pdf["v"].to_list(), dim)
            if len(pdf):
                pdf["far"] = list(_distances(_augmented(x, radius), chosen))
                pdf["q_far"] = list(_distances(_query_points(x, radius), chosen))
                yield pdf[["row", "id", "v", "is_query", "far", "q_far"]]

    index = materialise(rows.mapInPandas(table, "row long, id long, v array<double>, is_query boolean, far array<double>, q_far array<double>"), "pivot-table")
    n_blocks, n_query_blocks = -(-n // candidate_block), -(-nq // query_block)
    to_block = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cand = index.select("row", "id", "v", "far", to_block(n_blocks).cast("int").alias("cb"), each(n_query_blocks).alias("qb"))
    query = index.where("is_query").select("row", "id", "v", F.col("q_far").alias("far"), each(n_blocks).alias("cb"), to_block(n_query_blocks).cast("int").alias("qb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in ("query_row", "query_id", "id", "score")})
        width = len(chosen)
        found = search_block(left["row"].to_numpy(), _stack(left["v"].to_list(), dim), _stack(left["far"].to_list(), width),
                             right["row"].to_numpy(), _stack(right["v"].to_list(), dim), _stack(right["far"].to_list(), width), radius, k, right["id"].to_numpy())
        ids = dict(zip(left["row"], left["id"]))
        return pd.DataFrame([(q, ids[q], i, s) for q, i, s in found], columns=["query_row", "query_id", "id", "score"])

    best = query.groupBy("cb", "qb").cogroup(cand.groupBy("cb", "qb")).applyInPandas(cell, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
