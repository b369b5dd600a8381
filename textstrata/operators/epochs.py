"""The best epoch of a softmax regression trained by full gradients.

Every epoch is one distributed pass: each task multiplies its rows' residuals
with their features (numpy on Arrow batches) and returns the sums, Spark adds
them up by weight, and the driver, which holds ``labels x (dimensions + 1)``
numbers, takes one step.  The same pass counts the hits on the test rows, so
weights and accuracy of every epoch are known when the last one ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textstrata.operators.stats import balanced_class_weights
from textstrata.session import written

HITS, ROWS, LOSS, WEIGHT = range(-4, 0)  # slots of the counts beside the gradient


def _pass(rows: DataFrame, weights: np.ndarray) -> dict[int, float]:
    """Sums over all rows at these weights: the gradient by slot, hits and rows of the test split, loss and weight of the train split."""
    labels, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, other = np.zeros((labels, width)), np.zeros(4)
        for b in batches:
            x = np.ones((b.num_rows, width))
            x[:, :-1] = b.column(0).flatten().to_numpy().reshape(b.num_rows, width - 1)
            y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
            logits = x @ weights.T
            test = np.isnan(w)
            other[HITS] += (logits[test].argmax(axis=1) == y[test]).sum()
            other[ROWS] += test.sum()
            x, y, w, logits = x[~test], y[~test], w[~test], logits[~test]
            log_p = logits - logits.max(axis=1, keepdims=True)
            log_p -= np.log(np.exp(log_p).sum(axis=1, keepdims=True))
            at = np.arange(len(y))
            other[LOSS] -= (w * log_p[at, y]).sum()
            other[WEIGHT] += w.sum()
            off = np.exp(log_p)
            off[at, y] -= 1.0
            slope += (off * w[:, None]).T @ x
        sums = np.concatenate([slope.ravel(), other])
        yield pa.RecordBatch.from_arrays([pa.array([*range(labels * width), *range(-4, 0)], pa.int32()), pa.array(sums)], names=["slot", "value"])

    return {r["slot"]: r["value"] for r in rows.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()}


def train_epochs(df: DataFrame, features_col: str, label_col: str, label_ids: dict[str, int], dimensions: int, epochs: int = 10,
                 rate: float = 1.0, split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """T1 + T2: ``(epoch, loss, accuracy, n_test, best)`` and the weight rows ``(epoch, label_id, weights)``.

    Epoch ``e`` are the weights after ``e`` steps from zero down the mean
    class-weighted cross-entropy of the train split (A1 and A11); ``accuracy`` is
    that of the test split.  ``best`` marks the highest accuracy, the first on
    ties.  A row without label, or whose features aren't ``dimensions`` numbers,
    fails the job.  Without test rows the accuracy is null and epoch 1 is best.
    """
    spark, labels = df.sparkSession, max(label_ids.values()) + 1
    label = F.coalesce(F.col(label_col).cast("int"), F.raise_error(F.lit(f"row without a label in {label_col}")).cast("int"))
    x = F.col(features_col).cast("array<double>")
    whole = (F.size(x) == dimensions) & ~F.exists(x, lambda v: v.isNull())
    x = F.when(whole, x).otherwise(F.raise_error(F.lit(f"features that aren't {dimensions} numbers")))
    rows = df.select(x.alias("x"), label.alias("label_id"), F.col(split_col).alias("_split")).where(F.col("_split").isin("train", "test"))
    rows = written(rows, "epoch-rows")
    weights_of = balanced_class_weights(rows, "label_id", label_ids, "_split", strict=False).select("label_id", "weight")
    weighed = written(rows.join(weights_of, "label_id", "left").select(
        "x", "label_id", F.when(F.col("_split") == "train", F.col("weight")).otherwise(F.lit(float("nan"))).alias("w")), "epoch-weights")

    weights, table, kept = np.zeros((labels, dimensions + 1)), [], []
    for epoch in range(epochs + 1):
        sums = _pass(weighed, weights)
        total = sums.get(WEIGHT, 0.0)
        n = int(sums.get(ROWS, 0))
        if epoch:
            table.append((epoch, sums.get(LOSS, 0.0) / total if total else None, sums[HITS] / n if n else None, n))
            kept += [(epoch, i, w.tolist()) for i, w in enumerate(weights)]
        if total and epoch < epochs:
            weights = weights - rate / total * np.array([sums[i] for i in range(weights.size)]).reshape(weights.shape)
    every = spark.createDataFrame(table, "epoch int, loss double, accuracy double, n_test long")
    first = F.max_by("epoch", F.struct(F.coalesce("accuracy", F.lit(-1.0)), -F.col("epoch"))).over(Window.partitionBy(F.lit(0)))
    return every.withColumn("best", F.col("epoch") == first), spark.createDataFrame(kept, "epoch int, label_id int, weights array<double>")
