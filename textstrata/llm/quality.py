"""Quality by regularised quadratic discriminant analysis.

Statistics of whole texts are transformed to be roughly normal; each class gets
a mean and a covariance shrunk towards the pooled covariance and its diagonal.
A score is the difference of the two Gaussian log densities, from Mahalanobis
distances by Cholesky factors that are inverted once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, utf8

SYMBOLS = b"#*$%&<>"
NAMES = ("log_words", "word_bytes", "symbols", "pipes", "distinct", "adjacent", "top_word", "dup_lines", "digits",
         "capitals", "sentence_ends", "non_ascii", "short_words", "log_line_words", "odd_ends")


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``.

    Rates become ``log((count + 0.5) / (all + 1))``; null and empty texts have all counts zero.
    """
    text = text or b""
    words = text.split()
    n, chars = len(words), sum(map(len, words))
    rate = lambda count, all_: math.log((count + 0.5) / (all_ + 1.0))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda chars_: len(text) - len(text.translate(None, chars_))
    ascii_ = len(text.translate(None, bytes(range(128))))
    return [
        math.log1p(n), math.log((chars + 1) / (n + 1)), rate(count(SYMBOLS), chars), rate(count(b"|"), n),
        math.log((len(seen) + 1) / (n + 1)), rate(sum(map(bytes.__eq__, words, words[1:])), n), rate(max(seen.values(), default=0), n),
        rate(len(lines) - len(set(lines)), len(lines)), rate(count(b"0123456789"), chars), rate(count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        rate(count(b".!?"), n), rate(ascii_, chars), rate(sum(len(w) <= 3 for w in words), n), math.log((n + 1) / (len(lines) + 1)),
        rate(sum(w[-1:] in (b"#", b"*", b"$", b"%", b"&") for w in words), n)]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)`` per row; row-local."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t) for t in utf8(b.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["id", "x"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, x array<double>")


class Discriminant:
    """Two Gaussians with shrunk covariances.

    ``moments`` maps class 0 and 1 to (rows, sum of x, sum of x x'), which add
    up over any partition of the rows.  With one class only, every score is
    that class (0.5 with none).
    """

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.2, to_diagonal: float = 0.1):
        self.only = None
        rows = {c: moments[c][0] for c in moments if moments[c][0] > 0}
        if len(rows) < 2:
            self.only = float(next(iter(rows))) if rows else 0.5
            return
        spread = {c: moments[c][2] - np.outer(moments[c][1], moments[c][1]) / rows[c] for c in rows}
        pooled = sum(spread.values()) / sum(rows.values())
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
        total = sum(rows.values())
        self.parts = []
        for c in (0, 1):
            own = spread[c] / rows[c]
            shrunk = (1 - to_pooled - to_diagonal) * own + to_pooled * pooled + to_diagonal * diagonal
            factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(len(shrunk)))
            constant = math.log(rows[c] / total) - np.log(np.diag(factor)).sum()
            self.parts.append((moments[c][1] / rows[c], np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if self.only is not None:
            return np.full(len(x), self.only)
        log = [c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, c in self.parts]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fits on ``(x, label)`` rows; two moments per class reach the driver, however many rows there are."""
    d = len(NAMES)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for pdf in frames:
            for c in (0, 1):
                x = np.array(pdf["x"][pdf["label"] == c].to_list()).reshape(-1, d)
                total[c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "at": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    sums = labelled.mapInPandas(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums:
        flat[r.label, r.at] = r.value
    return Discriminant({c: (flat[c, 0], flat[c, 1:1 + d], flat[c, 1 + d:].reshape(d, d)) for c in (0, 1)})


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per input row: the probability of label 1.

    ``labels`` is ``(id, label)`` with labels 0 and 1; other and null labels
    and ids without a document are left out, and a repeated label counts each
    time.  All labelled rows are used.  Null and empty texts are scored like
    any other; repeated rows each get a row.
    """
    rows = materialise(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.where("label in (0, 1)").select(F.col("id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label"))
    model = fit(rows.join(known, rows["id"] == known["label_id"]).select("x", "label"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "score": model.score(np.array(pdf["x"].to_list()))})

    return rows.mapInPandas(run, "id long, score double")
