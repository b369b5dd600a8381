"""Round 4: the language model's features are words, large tables and memory of tasks and driver."""

import time

import numpy as np
import pytest

from textstrata.llm import maxent, toxicity
from textstrata.operators import bayes


def test_language_model_tells_words_with_one_ending_apart(spark):
    """Words beyond the most frequent ones that end alike are features of their own, in the bounded table and outside it."""
    fillers = [" ".join(f"w{i}f" for i in range(k, 150, 3)) for k in range(3)] * 40
    train = spark.createDataFrame([(t,) for t in fillers + ["aaxyz left", "bbxyz right"] * 30], "text string")
    counts = maxent.materialise(maxent.count_words(train), "t")
    asked = ["aaxyz left", "aaxyz right", "bbxyz right", "bbxyz left"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for lookup in (100, maxent.LOOKUP):
        vocab = maxent.vocabulary(counts, lookup)
        codes = vocab.codes()
        assert len({vocab.context[0][codes[w.encode()]] for w in ("aaxyz", "bbxyz", "w1f", "w2f")}) == 4
        weights = maxent.train(maxent.context_cells(train, vocab), 10)
        p = [r.score for r in maxent.score(docs, counts, vocab, weights).orderBy("id").collect()]
        assert p[0] > p[1] + 0.3 and p[2] > p[3] + 0.3


def test_language_model_gradient_equals_a_plain_loop(spark):
    texts = ["a b c a b", "b a", "", None, "c c zzz a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    vocab = maxent.vocabulary(maxent.materialise(maxent.count_words(docs), "t"))
    weights = np.random.default_rng(1).normal(size=(maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    want, fit, codes, size = np.zeros(weights.shape), 0.0, vocab.codes(), sum(maxent.NEAR)
    for t in texts:
        before = [0, 0, 0]
        for w in [*(t or "").encode().split(), b""]:
            near, middle, far = before
            o = vocab.output[codes[w]]
            cls, member = vocab.cls[o], vocab.member[o]
            for layer, context, choice in ((0, (near * size + middle) * size + far, cls), (1, (cls * size + near) * size + middle, member)):
                rows = maxent.feature_rows(layer, np.array([context]))
                logits = weights[rows[0]].astype(float).sum(axis=0)
                p = np.exp(logits - np.log(np.exp(logits).sum()))
                fit += np.log(p[choice])
                for r in rows[0]:
                    want[r] -= p
                    want[r, choice] += 1
            before = [vocab.context[0][codes[w]], *before[:2]]
    slope, total = maxent.gradient(maxent.context_cells(docs, vocab), weights)
    assert total == pytest.approx(fit, rel=1e-5) and np.allclose(slope, want, atol=1e-4)


def test_language_model_sums_slopes_fast_in_tasks(spark):
    """Weights are unpickled in tasks, where element-wise additions by index (np.add.at) took 30 microseconds a token."""
    texts = [" ".join(f"w{(i * j) % 9973}" for j in range(500)) for i in range(600)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    vocab = maxent.vocabulary(maxent.materialise(maxent.count_words(docs), "t"))
    cells = maxent.materialise(maxent.context_cells(docs, vocab), "t")
    weights = np.zeros((maxent.ROWS, maxent.WIDTH), np.float32)
    maxent.gradient(cells.limit(1), weights)
    began = time.perf_counter()
    slope, _ = maxent.gradient(cells, weights)
    assert time.perf_counter() - began < 6 and abs(slope.sum()) < 1


def test_toxicity_model_reaches_the_driver_without_row_objects(spark, monkeypatch):
    """The vocabulary is the one table that grows with the corpus: it must not become a row object per word."""
    rows = spark.range(60).selectExpr("'plain wordy text' as text", "cast(id % 2 as int) as label")
    monkeypatch.setattr(type(rows), "collect", lambda self: pytest.fail("rows are collected"))
    assert toxicity.vocabulary_of(rows) == {"plain": 60, "wordy": 60, "text": 60}


def test_votes_are_the_same_from_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 2)
    words = {"stupid", "stupidity", "loser", "plain", "x" * 60}
    weights = {"stupid": 2.0, "stup*": 1.5, "stupid*": 3.0, "loser": 1.0, "xxxx*": 4.0}
    lexicon = toxicity.Lexicon(weights)
    assert lexicon.votes(words) == lexicon.votes(words) == [4.0, 3.0, 2.0, 1.0] and len(lexicon.known) <= 2


def test_toxicity_shuffles_texts_alike_at_every_size(spark):
    """Small labels aren't broadcast: the texts are grouped by id anyway, and the plan doesn't change as they grow."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('some text ', id) as text")
    plans, write = [], toxicity.materialise
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
        toxicity.fit(docs, docs.selectExpr("doc_id as id", "cast(doc_id % 2 as int) as label"))
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_bayes_shuffles_no_frequent_word(spark, monkeypatch):
    """Places of frequent words are summed where the texts are; only rare words meet the model in a shuffled join, and no score changes."""
    texts = ["the the the sand", "the clay the w1", None, "", "the w2 w3 clay clay", "unknown the"] + [f"the v{i} sand" for i in range(40)]
    df = spark.createDataFrame([(i // 2 if i < 4 else i, t, i % 2) for i, t in enumerate(texts)], "k long, text string, y int")
    df = df.withColumn("z", 1 - df["y"]).repartition(3)
    model = bayes.train(df, "text", {"X": "y", "Y": "z"}, 3)
    every = sorted(bayes.score(df, ["k"], "text", model, ["X", "Y"], 3).collect())
    monkeypatch.setattr(bayes, "HEAD_TOKENS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = bayes.score(df, ["k"], "text", model, ["X", "Y"], 3)
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(some.collect()) == every and len(every) == len(texts) - 2
        assert "LeftAnti" in plan and "strategy=broadcast" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
