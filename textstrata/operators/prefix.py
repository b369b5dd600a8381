"""Running totals and ranks over a whole table in a total order.

A window without a partition key would bring the table into one task.  Here the
rows are cut into ordered ranges, each range is summed on its own, and only the
totals of the ranges (one short row per range) meet in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.session import written


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, out_col: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in ``order``.

    ``order`` must be a total order of the rows.  The ranges are written to the
    shared folder with their number, so that a retried task sees the same cut.
    An empty table stays empty.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.withColumn("_ts_v", value.cast("long")).repartitionByRange(parts, *order)
                     .withColumn("_ts_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(F.col("_ts_range").alias("_ts_r")).agg(F.sum("_ts_v").alias("_ts_t"))
    before = Window.orderBy("_ts_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_ts_r", F.coalesce(F.sum("_ts_t").over(before), F.lit(0)).alias("_ts_o"))
    inside = Window.partitionBy("_ts_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("_ts_s", F.sum("_ts_v").over(inside))
            .join(F.broadcast(offsets), F.col("_ts_range") == F.col("_ts_r"))
            .withColumn(out_col, F.col("_ts_s") + F.col("_ts_o"))
            .drop("_ts_v", "_ts_range", "_ts_r", "_ts_o", "_ts_s"))
