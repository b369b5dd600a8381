"""Aggregations and statistics.

Every statistic is computed from partial aggregates (counts per label, per
cell), so the rows are combined map-side and only tables with one row per
label or per cell are shuffled.  Nothing row-sized reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textstrata.functions.arrays import argmax, nll
from textstrata.session import written


def _classes_frame(df: DataFrame, mapping: Mapping[str, int]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        sorted(((v, k) for k, v in mapping.items())), "label_id int, label string")


def balanced_class_weights(df: DataFrame, label_col: str, mapping: Mapping[str, int],
                           split_col: str | None = "split", train_value: str = "train",
                           strict: bool = True) -> DataFrame:
    """A1: ``w_c = n / (K * n_c)`` over the training rows, one row per class.

    ``label_col`` holds label ids; ``mapping`` is the label table (name -> id).
    Strict (the library's behaviour): a class without training rows, or a
    row whose label is missing or not in the table, fails the job.  Otherwise
    such rows are left out, ``K`` counts the classes that have rows, and a
    class without rows gets a null weight.
    """
    src = df.where(F.col(split_col) == train_value) if split_col else df
    counts = src.groupBy(F.col(label_col).cast("int").alias("label_id")).agg(
        F.count(F.lit(1)).alias("n_c"))
    classes = _classes_frame(df, mapping).withColumn("_known", F.lit(True))
    joined = counts.join(classes, "label_id", "full_outer")
    if strict:
        joined = joined.withColumn("n_c", F.when(
            F.col("_known").isNull(),
            F.raise_error(F.concat(F.lit("label not in the label table: "),
                                   F.coalesce(F.col("label_id").cast("string"), F.lit("null")))))
            .when(F.col("n_c").isNull(),
                  F.raise_error(F.concat(F.lit("class without training rows: "), F.col("label"))))
            .otherwise(F.col("n_c")))
    else:
        joined = joined.where(F.col("_known").isNotNull())
    everything = Window.partitionBy()
    present = F.col("n_c").isNotNull() & (F.col("n_c") > 0)
    n = F.sum(F.when(present, F.col("n_c"))).over(everything)
    k = F.count(F.when(present, F.lit(1))).over(everything)
    return joined.select(
        "label_id", "label",
        F.coalesce(F.col("n_c"), F.lit(0)).cast("long").alias("n"),
        F.when(present, n.cast("double") / (k * F.col("n_c")).cast("double")).alias("weight"),
    )


def crosstab(df: DataFrame, first: str, second: str, count_col: str = "n") -> DataFrame:
    """A5: sparse cross-tabulation; rows with a missing value drop out."""
    return (df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
            .groupBy(first, second).agg(F.count(F.lit(1)).alias(count_col)))


def _cramers_v_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cramér's V per ``keys`` group from sparse cells (keys, a, b, o).

    ``chi2 = n * (sum o^2/(R*C) - 1)`` over the non-empty cells only, then
    ``V = sqrt(chi2 / n / min(r-1, c-1))``; null when either side has one value.
    """
    rows = cells.groupBy(*keys, "a").agg(F.sum("o").alias("R"))
    cols = cells.groupBy(*keys, "b").agg(F.sum("o").alias("C"))
    joined = cells.join(rows, [*keys, "a"]).join(cols, [*keys, "b"])
    term = (F.col("o").cast("double") / F.col("R")) * (F.col("o").cast("double") / F.col("C"))
    stat = joined.groupBy(*keys).agg(
        F.sum("o").alias("n"),
        F.sum(term).alias("_s"),
        F.count_distinct("a").alias("r"),
        F.count_distinct("b").alias("c"),
    )
    chi2 = F.col("n") * (F.col("_s") - 1.0)
    dof = F.least(F.col("r"), F.col("c")) - 1
    return stat.select(
        *keys, "n",
        F.greatest(chi2, F.lit(0.0)).alias("chi2"),
        F.when(dof > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / F.col("n") / dof)).alias("cramers_v"),
    )


def association(df: DataFrame, first: str, second: str) -> DataFrame:
    """Cramér's V between two columns (no continuity correction); one row."""
    cells = crosstab(df, first, second, "o").select(
        F.col(first).alias("a"), F.col(second).alias("b"), "o")
    return _cramers_v_from_cells(cells, [])


def association_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Cramér's V for several column pairs with one shared aggregation.

    The pairs are stacked (values as strings) and counted in one
    ``groupBy(pair, a, b)``, instead of one job per pair.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("string").alias("a"),
                 F.col(b).cast("string").alias("b"))
        for a, b in pairs])).alias("_p")).select("_p.*")
    cells = (stacked.where(F.col("a").isNotNull() & F.col("b").isNotNull())
             .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("o")))
    return _cramers_v_from_cells(cells, ["pair"])


def confusion_counts(df: DataFrame, true_col: str, pred_col: str,
                     normalize: str | None = None) -> DataFrame:
    """Dense confusion matrix ``(y_true, y_pred, n[, value])``.

    Labels are the union of both columns; a row without a true or predicted
    label fails the job.  ``normalize``: ``None`` counts, ``"true"`` by row
    total, ``"pred"`` by column total, ``"all"`` by the grand total; an empty
    row or column normalises to 0.  The counts are one partial aggregation,
    written once.  Each label is then expanded by the list of labels (a literal
    as long as one row of the matrix, whatever its length) into its row of zero
    cells, added by a union and a second aggregation (no join).
    """
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError("normalize must be None, 'true', 'pred' or 'all'")

    def present(c: str, name: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"row without a label in {name}"))).otherwise(F.col(c))

    cells = written(df.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
                    .select(present("t", true_col).alias("y_true"), present("p", pred_col).alias("y_pred"), "n"), "cells")
    labels = (cells.select(F.col("y_true").alias("l"))
              .union(cells.select(F.col("y_pred").alias("l"))).distinct())
    names = sorted(r["l"] for r in labels.collect())
    every = F.array(*[F.lit(v) for v in names]).cast(f"array<{cells.schema['y_true'].dataType.simpleString()}>")
    grid = (labels.select(F.col("l").alias("y_true"), F.explode(every).alias("y_pred"))
            .withColumn("n", F.lit(0).cast("long")))
    dense = grid.unionByName(cells).groupBy("y_true", "y_pred").agg(F.sum("n").cast("long").alias("n"))
    if normalize is None:
        return dense
    total = {"true": F.sum("n").over(Window.partitionBy("y_true")),
             "pred": F.sum("n").over(Window.partitionBy("y_pred")),
             "all": F.lit(cells.agg(F.sum("n")).first()[0])}[normalize]
    return dense.withColumn("value", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def argmax_accuracy(df: DataFrame, logits_col: str | Column, label_col: str) -> DataFrame:
    """A10: share of rows whose argmax equals the label; one row.

    ``n`` counts the rows that the share is taken over: rows without a label or
    without logits are in neither.
    """
    hit = (argmax(logits_col) == F.col(label_col)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(hit).alias("n"))


def weighted_cross_entropy(df: DataFrame, logits_col: str | Column, label_col: str,
                           weights: DataFrame | None = None) -> DataFrame:
    """Class-weighted mean cross-entropy ``sum(w*nll) / sum(w)``; one row.

    ``weights`` is a ``(label_id, weight)`` table (for example from A1), joined
    by label; a row whose label has no weight fails the job.  Without it every
    weight is 1.  ``n`` counts the rows in the loss; rows without a label are
    in neither.
    """
    rows = df.select(F.col(label_col).cast("int").alias("label_id"),
                     nll(logits_col, label_col).alias("_nll"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.where("label_id is not null").join(weights.select("label_id", "weight"), "label_id", "left")
        missing = F.raise_error(F.concat(F.lit("no weight for label "), F.col("label_id").cast("string")))
        rows = rows.withColumn("weight", F.coalesce("weight", missing.cast("double")))
    return rows.agg((F.sum(F.col("weight") * F.col("_nll")) / F.sum("weight")).alias("loss"),
                    F.count("_nll").alias("n"))


def classification_metrics(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Accuracy, balanced accuracy and Matthews correlation; one row.

    All three come from per-label totals (true count ``t_k``, predicted count
    ``p_k``, correct ``d_k``), which one aggregation produces without a join:
    balanced accuracy is the mean of ``d_k/t_k`` over labels that occur in the
    truth; ``MCC = (c*s - sum p_k t_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2))``,
    0 when the root is 0.  A row without a true or predicted label fails the job,
    as in ``confusion_counts``.
    """
    missing = F.raise_error(F.lit("a row has no true or no predicted label"))
    t, p = (F.coalesce(F.col(c).cast("string"), missing.cast("string")) for c in (true_col, pred_col))
    per_row = df.select(F.explode(F.array(
        F.struct(t.alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (t == p).cast("int").alias("d")),
        F.struct(p.alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("d")),
    )).alias("_e")).select("_e.*")
    per_label = per_row.groupBy("k").agg(F.sum("t").cast("double").alias("t"),
                                         F.sum("p").cast("double").alias("p"),
                                         F.sum("d").cast("double").alias("d"))
    agg = per_label.agg(
        F.sum("t").alias("s"), F.sum("d").alias("c"),
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.avg(F.when(F.col("t") > 0, F.col("d") / F.col("t"))).alias("balanced_accuracy"),
    )
    cov_tp = F.col("c") * F.col("s") - F.col("tp")
    cov_pp = F.col("s") * F.col("s") - F.col("pp")
    cov_tt = F.col("s") * F.col("s") - F.col("tt")
    return agg.select(
        (F.col("c") / F.col("s")).alias("accuracy"),
        "balanced_accuracy",
        F.when(cov_pp * cov_tt == 0, F.lit(0.0))
        .otherwise(cov_tp / F.sqrt(cov_tt * cov_pp)).alias("mcc"),
    )


def metrics_from_counts(counts: DataFrame, by: Sequence[str], true_col: str, pred_col: str, count_col: str) -> DataFrame:
    """A12 per group of a table of cell counts: accuracy, balanced accuracy and Matthews correlation.

    Two small aggregations (per label, then per group); the same formulas as
    ``classification_metrics``.
    """
    t, p, n = F.col(true_col), F.col(pred_col), F.col(count_col).cast("double")
    sides = counts.select(*by, F.explode(F.array(
        F.struct(t.alias("k"), n.alias("t"), F.lit(0.0).alias("p"), F.when(t == p, n).otherwise(0.0).alias("d")),
        F.struct(p.alias("k"), F.lit(0.0).alias("t"), n.alias("p"), F.lit(0.0).alias("d")))).alias("_e")).select(*by, "_e.*")
    per_label = sides.groupBy(*by, "k").agg(*[F.sum(c).alias(c) for c in "tpd"])
    sums = per_label.groupBy(*by).agg(
        F.sum("t").alias("s"), F.sum("d").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"), F.avg(F.when(F.col("t") > 0, F.col("d") / F.col("t"))).alias("balanced_accuracy"))
    square = F.col("s") * F.col("s")
    root = (square - F.col("pp")) * (square - F.col("tt"))
    return sums.select(*by, (F.col("c") / F.col("s")).alias("accuracy"), "balanced_accuracy",
                       F.when(root == 0, F.lit(0.0)).otherwise((F.col("c") * F.col("s") - F.col("tp")) / F.sqrt(root)).alias("mcc"))
