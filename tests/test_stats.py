"""A1, A5-A12 against direct computations."""
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from textstrata.operators import stats

MAP = {"a": 0, "b": 1, "c": 2}


def weights(spark, labels, strict=True, mapping=MAP):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "id int, y int")
    return {r["label_id"]: (r["n"], r["weight"]) for r in
            stats.balanced_class_weights(df, "y", mapping, split_col=None, strict=strict).collect()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=3, max_size=60).filter(lambda v: set(v) == {0, 1, 2}))
def test_weights_formula(spark, labels):
    got = weights(spark, labels)
    n = len(labels)
    for c in range(3):
        n_c = labels.count(c)
        assert got[c][0] == n_c
        assert got[c][1] == n / (3 * n_c)
    assert abs(sum(nc * w for nc, w in got.values()) - n) < 1e-9


def test_weights_errors(spark):
    with pytest.raises(PySparkException):
        weights(spark, [0, 0, 1])                 # class 2 has no rows
    with pytest.raises(PySparkException):
        weights(spark, [0, 1, 2, None])           # unmapped label
    lax = weights(spark, [0, 0, 1, None], strict=False)
    assert lax[2] == (0, None) and lax[0][1] == 3 / (2 * 2)


def assoc(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return stats.association(df, "a", "b").first()


def test_association_edges(spark):
    assert assoc(spark, [("x", "p"), ("x", "q")])["cramers_v"] is None          # one value
    ind = [(a, b) for a in "xy" for b in "pq" for _ in range(5)]
    assert abs(assoc(spark, ind)["cramers_v"]) < 1e-12                          # independent
    same = [(v, v) for v in "xyz" for _ in range(4)]
    assert abs(assoc(spark, same)["cramers_v"] - 1.0) < 1e-12                   # identical


def test_association_against_dense(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, 500)
    b = (a + rng.integers(0, 3, 500)) % 5
    got = assoc(spark, [(str(x), str(y)) for x, y in zip(a, b)])["cramers_v"]
    table = np.zeros((4, 5))
    for x, y in zip(a, b):
        table[x, y] += 1
    exp = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi2 = ((table - exp) ** 2 / exp).sum()
    assert abs(got - math.sqrt(chi2 / 500 / 3)) < 1e-12
    pairs = stats.association_pairs(spark.createDataFrame(
        [(str(x), str(y), str(y)) for x, y in zip(a, b)], "a string, b string, c string"),
        [("a", "b"), ("b", "c")]).collect()
    got_pairs = {r["pair"]: r["cramers_v"] for r in pairs}
    assert abs(got_pairs["a|b"] - got) < 1e-12 and abs(got_pairs["b|c"] - 1.0) < 1e-12


def metrics_brute(t, p):
    labels = sorted(set(t) | set(p))
    idx = {v: i for i, v in enumerate(labels)}
    cm = np.zeros((len(labels), len(labels)))
    for x, y in zip(t, p):
        cm[idx[x], idx[y]] += 1
    acc = np.trace(cm) / cm.sum()
    rows = cm.sum(1)
    bal = np.mean([cm[i, i] / rows[i] for i in range(len(labels)) if rows[i] > 0])
    tk, pk, c, s = cm.sum(1), cm.sum(0), np.trace(cm), cm.sum()
    den = (s * s - (pk * pk).sum()) * (s * s - (tk * tk).sum())
    mcc = 0.0 if den == 0 else (c * s - (tk * pk).sum()) / math.sqrt(den)
    return cm, labels, acc, bal, mcc


def test_confusion_and_metrics(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 5, 300).tolist()
    p = [x if rng.random() < 0.6 else int(rng.integers(0, 6)) for x in t]   # 5 only predicted
    df = spark.createDataFrame(list(zip(t, p)), "t int, p int")
    cm, labels, acc, bal, mcc = metrics_brute(t, p)
    cc = {(r["y_true"], r["y_pred"]): r["n"] for r in stats.confusion_counts(df, "t", "p").collect()}
    assert len(cc) == len(labels) ** 2
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            assert cc[(a, b)] == cm[i, j]
    norm = {(r["y_true"], r["y_pred"]): r["value"] for r in
            stats.confusion_counts(df, "t", "p", normalize="true").collect()}
    assert norm[(5, 5)] == 0.0                       # empty true row normalises to 0
    assert abs(norm[(0, 0)] - cm[0, 0] / cm[0].sum()) < 1e-12
    m = stats.classification_metrics(df, "t", "p").first()
    assert abs(m["accuracy"] - acc) < 1e-12
    assert abs(m["balanced_accuracy"] - bal) < 1e-12
    assert abs(m["mcc"] - mcc) < 1e-12


def test_argmax_and_weighted_ce(spark):
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(50, 4))
    y = rng.integers(0, 4, 50)
    df = spark.createDataFrame([(x.tolist(), int(v)) for x, v in zip(logits, y)], "l array<double>, y int")
    acc = stats.argmax_accuracy(df, "l", "y").first()["accuracy"]
    assert abs(acc - np.mean(logits.argmax(1) == y)) < 1e-12
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5), (3, 1.5)], "label_id int, weight double")
    loss = stats.weighted_cross_entropy(df, "l", "y", w).first()["loss"]
    lse = np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1)) + logits.max(1)
    nll = lse - logits[np.arange(50), y]
    ww = np.array([1.0, 2.0, 0.5, 1.5])[y]
    assert abs(loss - (ww * nll).sum() / ww.sum()) < 1e-9
