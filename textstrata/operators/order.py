"""Ordered carry-forward: the "idem" expansion.

A row whose text starts with *idem* takes the text of the nearest earlier
non-idem row of the same site, followed by what stands after the word *idem*.

Spark has no row order, so the order is an explicit column.  One site may hold a
third of all rows, so the scan is cut into segments, one per (site, chunk of the
order key): the rows are shuffled and sorted once by segment, every row gets the
last base of its own segment, and the result is written with a mark on the last
row of each segment.  Which earlier segment a segment inherits from is decided on
numbers alone (site, chunk, has a base), first inside blocks of ``chunk_width``
chunks, then across blocks, so no task sees more than one short row per
``chunk_width ** 2`` positions of a site.  Only idem rows that stand before the
first base of their segment are joined with an inherited base; they are a
partition of the written table, and all other rows are just read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.functions.text import IDEM_MARKER, after_marker, starts_with_idem
from textstrata.session import shared_path

#: Positions per chunk.  The order identifies a row within its site, so with a
#: whole-number order it also bounds the rows of one group.
CHUNK_WIDTH = 1 << 15


def _inherits_from(ends: DataFrame, width: int) -> DataFrame:
    """``(_ts_site, _ts_chunk, _ts_from)``: for each segment the last earlier one of
    its site that holds a base; segments without one are left out.  ``ends`` has one
    row per segment with ``_ts_full`` (holds a base)."""
    own = F.when(F.col("_ts_full"), F.col("_ts_chunk"))
    cut = ends.select("_ts_site", "_ts_chunk", own.alias("_ts_own"),
                      F.floor(F.col("_ts_chunk") / F.lit(width)).cast("long").alias("_ts_block"))
    inside = (Window.partitionBy("_ts_site", "_ts_block").orderBy("_ts_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy("_ts_site").orderBy("_ts_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    near = cut.withColumn("_ts_near", F.max("_ts_own").over(inside))
    blocks = cut.groupBy("_ts_site", "_ts_block").agg(F.max("_ts_own").alias("_ts_end"))
    far = blocks.select("_ts_site", "_ts_block", F.max("_ts_end").over(across).alias("_ts_far"))
    return (near.join(far, ["_ts_site", "_ts_block"])
            .select("_ts_site", "_ts_chunk", F.coalesce("_ts_near", "_ts_far").alias("_ts_from"))
            .where("_ts_from is not null"))


def _scan_segments(keyed: DataFrame, base_value: Column, order_col: str) -> DataFrame:
    """Adds the last base inside its segment (``_ts_base``, on idem rows and segment ends),
    the mark of a segment's last row and of idem rows before its first base: one exchange, one sort."""
    by = Window.partitionBy("_ts_site", "_ts_chunk").orderBy(order_col)
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = (keyed.withColumn("_ts_base", F.last(base_value, ignorenulls=True).over(up_to))
               .withColumn("_ts_last", F.lead(F.lit(True)).over(by).isNull()))
    return (scanned.withColumn("_ts_open", F.col("_ts_idem") & F.col("_ts_base").isNull())
            .withColumn("_ts_base", F.when(F.col("_ts_idem") | F.col("_ts_last"), F.col("_ts_base"))))


def expand_idem(df: DataFrame, site_cols: Sequence[str], order_col: str, text_col: str,
                out_col: str | None = None, marker: str = IDEM_MARKER,
                rest_match: str = "exact", chunk_width: int = CHUNK_WIDTH,
                flag_col: str = "idem_unresolved") -> DataFrame:
    """W1 + W2.

    ``rest_match="exact"`` cuts after the first lower-case marker (the
    reference's rule: "Idem, grijs" keeps no rest); ``"ignore_case"`` cuts
    after the first marker in any case.  Several idem rows in a row all take
    the same base.  An idem row without an earlier non-idem row in its site
    keeps its text and gets ``flag_col = true`` (the reference aborts there).
    Null text is not idem and is never a base.  Rows are chunked by
    ``floor(order / chunk_width)`` (numbers or timestamps as the order; the
    order identifies a row within its site, as the row position does).  The
    segments are written to the shared folder while the plan is built; an empty
    table gives an empty result.
    """
    if rest_match not in ("exact", "ignore_case"):
        raise ValueError("rest_match must be 'exact' or 'ignore_case'")
    out_col = out_col or text_col
    site = list(site_cols)
    text = F.col(text_col)
    idem = starts_with_idem(text, marker)
    # Any monotone chunking is correct (the carry crosses chunk borders); a
    # double keeps numbers and timestamps usable as the order.
    chunk = F.floor(F.col(order_col).cast("double") / F.lit(float(chunk_width))).cast("long")
    # One struct key for the site: never null itself, so plain equality keeps
    # a missing site value as a site of its own in windows and joins alike.
    keyed = (df.withColumn("_ts_site", F.struct(*[F.col(c) for c in site]))
             .withColumn("_ts_idem", idem).withColumn("_ts_chunk", chunk))
    base_value = F.when(~F.col("_ts_idem"), text)  # null text is never a base

    scanned = _scan_segments(keyed, base_value, order_col)
    path = shared_path(df.sparkSession, "idem-segments")
    scanned.write.partitionBy("_ts_open").parquet(path)
    stored = df.sparkSession.read.schema(scanned.schema).parquet(path)

    # The inheritance between segments, and the texts of the segments inherited from.
    ends = stored.where("_ts_last")
    heirs = _inherits_from(ends.select("_ts_site", "_ts_chunk", F.col("_ts_base").isNotNull().alias("_ts_full")), chunk_width)
    open_rows = stored.where("_ts_open").drop("_ts_base")
    donors = ends.select(F.col("_ts_site").alias("_ts_s"), F.col("_ts_chunk").alias("_ts_from"), "_ts_base")
    traced = open_rows.join(heirs, ["_ts_site", "_ts_chunk"], "left")
    inherited = (traced.join(donors, (traced["_ts_site"] == donors["_ts_s"]) & (traced["_ts_from"] == donors["_ts_from"]), "left")
                 .select(*stored.columns))

    rows = stored.where("not _ts_open").unionByName(inherited)
    base = F.col("_ts_base")
    rest = after_marker(text, marker, ignore_case=(rest_match == "ignore_case"))
    return (rows
            .withColumn(flag_col, F.col("_ts_idem") & base.isNull())
            .withColumn(out_col, F.when(F.col("_ts_idem") & base.isNotNull(), F.concat(base, rest)).otherwise(text))
            .select(*dict.fromkeys([*df.columns, flag_col, out_col])))
