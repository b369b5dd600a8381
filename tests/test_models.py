"""Models as tables, best epoch, cut-off intervals, learned languages, streams that see rows twice."""
import math
import os
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF01
from textstrata.functions.hashing import hash_bucket, hash_order
from textstrata.operators import bayes, encode, epochs, language, pick, stats
from textstrata.plans import bindings, jobs
from textstrata.sources import io
from textstrata.streaming.predict import start_stream

TABLE = {"a": 0, "b": 1, "c": 2, "none": 5}  # ids with gaps
ROWS = [(0, "Zand, zand klei", 0, 1), (1, "klei grind", 1, 1), (2, "zand", 0, None), (3, None, 1, 0), (4, "", 0, 1), (5, "Grind Grind 12", 1, 0), (6, "klei", 0, 1)]
SCHEMA = "row_id long, text string, x int, y int"


def brute_bayes(rows, target, num_labels, text):
    """Shares of the labels of one text, from scratch; null where a class has no rows."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rows = [(words(r[1]), r[2 + target]) for r in rows if r[2 + target] is not None]
    classes = sorted({y for _, y in rows})
    vocabulary = {w for ws, _ in rows for w in ws}
    logs = {}
    for c in classes:
        own = [ws for ws, y in rows if y == c]
        w = len(rows) / (len(classes) * len(own))
        n = Counter(x for ws in own for x in ws)
        below = w * sum(n.values()) + len(vocabulary)
        logs[c] = round(math.log(1 / len(classes)) * 1e6) + sum(round(math.log((w * n[x] + 1) / below) * 1e6) for x in words(text) if x in vocabulary)
    top = max(logs.values())
    e = {c: math.exp((v - top) / 1e6) for c, v in logs.items()}
    return [e.get(i, 0.0) / sum(e.values()) for i in range(num_labels)]


def test_bayes_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = bayes.train(df, "text", {"X": "x", "Y": "y"}, 3)
    texts = [r[1] for r in ROWS] + ["onbekend woord", "zand onbekend klei klei"]
    got = bayes.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), ["k"], "text", model, ["X", "Y"], 3).collect()
    assert len(got) == len(texts)
    for r in got:
        for i, c in enumerate(("s_X", "s_Y")):
            assert r[c] == pytest.approx(brute_bayes(ROWS, i, 3, texts[r.k]), abs=1e-12)
            assert r[c][2] == 0.0  # a class without training rows


def test_bayes_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="outside the table"):
        bayes.train(df, "text", {"X": "x"}, 1)
    model = bayes.train(df.where("false"), "text", {"X": "x"}, 2)
    assert bayes.score(df, ["row_id"], "text", model, ["X"], 2).first()["s_X"] == [0.0, 0.0]
    assert bayes.score(df.where("false"), ["row_id"], "text", bayes.train(df, "text", {"X": "x"}, 2), ["X"], 2).count() == 0


def test_table_bundle_is_checked_before_it_is_used(spark):
    path, labels = os.path.join(tempfile.mkdtemp(), "b"), {"a": 0, "b": 1}
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("split", F.lit("train"))
    jobs.train_tables_job(df, "text", {"X": "x", "Y": "y"}, labels, path)
    model = io.load_table_bundle(spark, path, ["X"], labels, "words")
    key = lambda r: (r.target, r.token)
    assert sorted(model.select("target", "token", "weights").collect(), key=key) == sorted(bayes.train(df, "text", {"X": "x"}, 2).collect(), key=key)
    with pytest.raises(FileNotFoundError, match="target=Z"):
        io.load_table_bundle(spark, path, ["X", "Z"], labels, "words")
    with pytest.raises(FileNotFoundError):
        io.load_table_bundle(spark, path + "-none", ["X"], labels, "words")
    with pytest.raises(ValueError, match="labels of X"):
        io.load_table_bundle(spark, path, ["X"], {"a": 0, "c": 1}, "words")
    with pytest.raises(ValueError, match="token rule"):
        io.load_table_bundle(spark, path, ["X"], labels, "edges")
    out = jobs.batch_predict_tables_job(spark, df, ["row_id"], "text", path, ["X", "Y"], labels, path + "-out", cutoff=0.0)
    assert out.count() == len(ROWS) and not out.where("X_label = Y_label").count()


def test_best_epoch(spark):
    rng = np.random.default_rng(3)
    rows = [([float(v) for v in rng.normal(size=3) + (2 * (i % 4 == 0))], int(i % 4 == 0), "test" if i % 5 == 0 else "train") for i in range(300)]
    df = spark.createDataFrame(rows, "v array<double>, y int, split string")
    table, weights = epochs.train_epochs(df, "v", "y", {"n": 0, "p": 1}, 3, epochs=6, rate=0.5)
    got = sorted(table.collect())
    losses = [r.loss for r in got]
    assert losses == sorted(losses, reverse=True) and [r.epoch for r in got if r.best] == [max(got, key=lambda r: (r.accuracy, -r.epoch)).epoch]
    w = np.zeros((2, 4))  # one step by hand, class weights on
    train = [(np.array([*x, 1.0]), y) for x, y, s in rows if s == "train"]
    n = Counter(y for _, y in train)
    wt = {y: len(train) / (2 * n[y]) for y in n}
    slope = sum(wt[y] * np.outer(np.array([0.5, 0.5]) - np.eye(2)[y], x) for x, y in train) / sum(wt[y] for _, y in train)
    first = {r.label_id: r.weights for r in weights.where("epoch = 1").collect()}
    assert np.allclose([first[0], first[1]], w - 0.5 * slope)


def test_best_epoch_edges(spark):
    df = spark.createDataFrame([([1.0], 0, "train"), ([2.0], 1, "train")], "v array<double>, y int, split string")
    got = epochs.train_epochs(df, "v", "y", {"n": 0, "p": 1}, 1, epochs=2)[0].collect()
    assert [(r.epoch, r.accuracy, r.best) for r in sorted(got)] == [(1, None, True), (2, None, False)]
    for bad in (df.withColumn("y", F.lit(None).cast("int")), df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))):
        with pytest.raises(Exception, match="without a label|aren't 1 numbers"):
            epochs.train_epochs(bad, "v", "y", {"n": 0, "p": 1}, 1, epochs=1)


def scores(rng):
    return [rng.choice([None, float("nan"), 0.0, 0.1, 0.25, 0.5, rng.random()]) for _ in range(rng.randrange(7))]


@pytest.mark.parametrize("cutoffs", [[0.1], [0.25, 0.1, 0.1, 0.5, 0.9], [i / 300 for i in range(300)]])
def test_sweep_counts_equal_picking_at_every_cutoff(spark, cutoffs):
    rng = random.Random(len(cutoffs))
    rows = [(scores(rng), scores(rng), rng.choice([0, 1, 2, 5]), rng.choice([0, 1, 2, 5])) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>, y int, z int")
    got = {(r.cutoff, r.target, r.truth, r.pick): r.n for r in pick.sweep_counts(df, {"P": "p", "Q": "q"}, {"P": "y", "Q": "z"}, TABLE, cutoffs).collect()}
    want = Counter()
    for p, q, y, z in rows:
        for c in sorted(set(cutoffs)):
            taken = set()
            for t, s, truth in (("P", p, y), ("Q", q, z)):
                open_ = [(-x, i) for i, x in enumerate(s) if x is not None and x >= c and i not in taken]
                best = min(open_)[1] if open_ else None
                taken |= {best} - {None}
                want[c, t, truth, 5 if best is None else best] += 1
    assert got == dict(want)


def test_sweep_rules(spark):
    df = spark.createDataFrame([([0.9, 0.1], 0), ([0.2, 0.8], None)], "p array<double>, y int")
    with pytest.raises(Exception, match="without a truth for P"):
        pick.sweep_counts(df, {"P": "p"}, {"P": "y"}, TABLE, [0.1]).collect()
    assert pick.sweep_counts(df.where("false"), {"P": "p"}, {"P": "y"}, TABLE, [0.1]).count() == 0
    picked = pick.pick_labels(df.select(F.array(F.lit(float("nan")), F.lit(0.5)).alias("p")), {"P": "p"}, TABLE, 0.1).first()
    assert (picked.P_label, picked.P_score) == ("b", 0.5)
    ranked = df.limit(1).select(pick.rank_scores(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.0, 0.0, 0.4)]), {0: "a", 2: "c", 5: "z"}).alias("r")).first()["r"]
    assert [(x.label_id, x.label) for x in ranked][:4] == [(5, "z"), (2, "c"), (1, None), (0, "a")]


def test_metrics_from_counts_equal_the_row_form(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(3), rng.choice([0, 1, 2, 5])) for g in (0.1, 0.2) for _ in range(60)] + [(0.3, 1, 1)] * 4
    df = spark.createDataFrame(rows, "cutoff double, truth int, pick int")
    counts = df.withColumn("target", F.lit("T")).groupBy("cutoff", "target", "truth", "pick").agg(F.count("*").alias("n"))
    got = {r.cutoff: tuple(r)[2:] for r in pick.cutoff_metrics(counts).collect()}
    for g in got:
        assert got[g] == pytest.approx(tuple(stats.classification_metrics(df.where(F.col("cutoff") == g), "truth", "pick").first()), abs=1e-12)
    best = {r.metric: (r.cutoff, r.value) for r in pick.best_cutoffs(pick.cutoff_metrics(counts)).collect()}
    assert best["accuracy"] == (0.3, 1.0) and set(best) == {"accuracy", "balanced_accuracy", "mcc"}


def test_learned_languages_hold_out(spark):
    docs = bindings.read(spark, SF01, "documents").select("doc_id", "lang", "text")
    teach = hash_bucket(hash_order(7, "doc_id"), 1) < "8"
    profiles = language.learn_profiles(docs.where(teach), "text", "lang", bindings.LANGUAGES)
    held = docs.where(~teach)
    right = language.detect(held, ["doc_id"], "text", profiles, bindings.LANGUAGES).join(held.drop("text"), "doc_id")
    by_lang = right.groupBy("lang").agg(F.avg((F.col("lang").eqNullSafe(F.col("detected"))).cast("int")).alias("share")).collect()
    assert len(by_lang) == 4 and all(r.share >= 0.95 for r in by_lang), by_lang
    blank = spark.createDataFrame([(1, None), (2, "12 .."), (3, "der die und nicht")], "k long, text string")
    found = language.detect(blank, ["k"], "text", profiles, bindings.LANGUAGES)
    assert {r.k: r.detected for r in found.collect()} == {1: None, 2: None, 3: "de"}
    assert sorted(r.k for r in language.drop_detected(blank, ["k"], found, "de").collect()) == [1, 2]


def test_hashing_fewer_words_gives_the_same_start(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " a  b c ", "a", "\na b\tc d e", "x " * 50])], "k long, text string")
    whole = {r.k: r.ids for r in encode.word_ids(df, "text", ["k"], 1000).collect()}
    for n in (1, 2, 3, 49, 50, 51):
        assert {r.k: r.ids for r in encode.word_ids(df, "text", ["k"], 1000, max_words=n).collect()} == {k: v[:n] for k, v in whole.items()}


def test_stream_drops_rows_that_come_again(spark):
    d = tempfile.mkdtemp()
    src, out, ckpt = (os.path.join(d, x) for x in ("in", "out", "ckpt"))
    rows = spark.range(20).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("at"))
    run = lambda: start_stream(spark, src, rows.schema, lambda x: x, out, ckpt, once_by=["id"], event_time="at").awaitTermination()
    rows.where("id < 10").write.mode("append").parquet(src)
    run()
    rows.where("id >= 5").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(20))
    with pytest.raises(ValueError):
        start_stream(spark, src, rows.schema, lambda x: x, out, ckpt, once_by=["id"])


def test_new_queries_have_sql():
    assert {"train_and_score_nb", "batch_predict_nb", "best_epoch", "language_profiles", "cutoff_metrics", "best_cutoffs", "sweep_counts_fine", "tune_cutoffs",
            "pretrain_words", "stream_once"} <= set(E.oracle_sql())
