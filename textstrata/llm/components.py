"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _hang_on_smallest(pairs: DataFrame) -> DataFrame:
    """Every neighbour ``v`` of ``u`` and ``u`` itself point at the smallest of them.

    The minimum is aggregated map-side and joined back, so that a node with
    very many neighbours is split by the skew join instead of meeting in one window.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge table of two long columns ``u``, ``v``.

    ``root`` is the smallest node reachable.  Repeated edges, loops and edges
    in either direction are allowed; an empty table gives an empty table.  Each
    round writes its edges to the shared folder; only a row count and a
    checksum reach the driver.
    """
    nodes = edges.select("u").union(edges.select(F.col("v").alias("u"))).distinct()
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (mark := _signature(now)) != before:
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of each node hang on its smallest one
        large = _hang_on_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours hang on the smallest one
        hung = _hang_on_smallest(large.distinct())
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "edges")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
