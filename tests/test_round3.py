"""Round 3: tables that are folders of files, whole training sets, memory and time of encodings."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from textstrata.llm import toxicity
from textstrata.operators import encode
from textstrata.operators import train as train_ops
from textstrata.plans.bindings import QUERIES


@pytest.mark.parametrize("name, table, key", [("stream_pick", "embeddings", "vec_id"), ("stream_predict", "documents", "doc_id")])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name, table, key):
    for t in ("embeddings", "documents", "labels"):
        spark.read.parquet(f"{SF001}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    assert os.path.isdir(f"{tmp_path}/{table}.parquet")
    folder = QUERIES[name](spark, str(tmp_path)).select(key)
    one_file = QUERIES[name](spark, SF001).select(key)
    assert folder.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()
    assert sorted(folder.collect()) == sorted(one_file.collect())


def test_class_weights_move_no_features(spark):
    rows = spark.range(2000).selectExpr("id", "cast(id % 2 as int) as y")
    weights = rows.groupBy(rows["y"].alias("label_id")).agg(F.avg("id").alias("weight"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # features and weights of unknown size
    try:
        out = train_ops._with_weights(rows, "y", weights)
        assert {r["_ts_w"] for r in out.collect()} == {999.0, 1000.0}
        assert out.rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_texts_are_encoded_from_the_ids_of_their_words(spark):
    from tokenizers import Tokenizer

    odd = ["", " \t\n", "a<|endoftext|>b <|startoftext|> x\x1cy\x85z w ́e é", "ΣΑΣ it's <|end oftext|> ﬁ İI",
           "漢字 ‍\U0001f469‍ ﻿ \x00 a\xa0b 　c", "grey sand " * 700]
    rows = spark.createDataFrame([(0, None), *enumerate(odd, 1)], "id int, text string").coalesce(1)
    tok = Tokenizer.from_file(encode.default_vocabulary())
    want = [[], *(tok.encode(t, add_special_tokens=False).ids for t in odd)]
    assert [r["ids"] for r in encode.token_ids(rows, "text", ["id"]).orderBy("id").collect()] == want
    # no more ids leave the task than truncation keeps, and its results stay
    kept = encode.token_ids(rows, "text", ["id"], max_ids=510)
    assert [r["ids"] for r in kept.orderBy("id").collect()] == [w[:510] for w in want]
    padded = encode.encode_padded(rows, "text", ["id"]).orderBy("id").collect()
    assert [r["input_ids"] for r in padded] == [([49406] + w[:510] + [49407] + [0] * 510)[:512] for w in want]
    assert "MapInArrow" in encode.encode_variable(rows, "text", ["id"])._jdf.queryExecution().toString()


def test_toxicity_learns_from_every_labelled_row(spark):
    """One rare word marks some rows among more labelled rows than the sample of 12,000 had."""
    n = 26_000
    rows = spark.range(n).selectExpr(
        "id as doc_id", "cast(id % 2600 < 4 as int) as label",
        "concat('plain words of text ', case when id % 2600 < 4 then concat('w', substr(translate(cast(id as string), '0123456789', 'abcdefghij'), 1, 2), ' vrokzat ') else '' end, 'end') as text")
    scorer = toxicity.fit(rows, rows.selectExpr("doc_id as id", "label"))
    learned = toxicity.vocabulary_of(rows)
    assert learned["plain"] == n and learned["vrokzat"] == rows.where("label = 1").count()
    assert scorer.decoder.words["vrokzat"] == pytest.approx(math.log(sum(learned.values()) / learned["vrokzat"]))
    assert float(scorer([b"some vrokzat here"])[0]) > 0.5 > float(scorer([b"plain words"])[0])


def test_logistic_curve_is_the_optimum(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + draw.normal(size=400) > 0.3).astype(int)
    w = toxicity.fit_logistic(spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, label int"))
    z = np.hstack([x, np.ones((400, 1))])
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.array([1, 1, 1e-3]) * w
    assert np.abs(slope).max() < 1e-6
