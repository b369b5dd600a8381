"""End-to-end jobs: dataset job from a delimited file, train + batch + stream
prediction (stream equals batch), sweep job, label-table rules."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textstrata.operators.labels import LITHOLOGY_LABELS, target_label2id
from textstrata.plans import jobs
from textstrata.sources import io
from textstrata.streaming.predict import start_stream_predict

WORDS = ["fijn zand", "grind", "klei", "veen", "leem"]


@pytest.fixture(scope="module")
def labelled_csv():
    d = tempfile.mkdtemp(prefix="textstrata-job-")
    path = os.path.join(d, "labelled.csv")
    with open(path, "w") as f:
        f.write("beschrijving;HL_cor;NL1_cor;NL2_cor\n")
        for i in range(200):
            main = LITHOLOGY_LABELS[i % 5 if i % 7 else 4]
            f.write(f'"{WORDS[i % 5]} met wat {WORDS[(i + 1) % 5]} nr {i}";{main};{LITHOLOGY_LABELS[(i + 1) % 9]};NA\n')
    return d, path


def test_target_label_tables():
    assert target_label2id("HL_cor") == {n: i for i, n in enumerate(LITHOLOGY_LABELS)}
    assert target_label2id("NL2_cor")["none"] == 9
    with pytest.raises(ValueError):
        target_label2id("other")


def test_dataset_job(spark, labelled_csv):
    d, path = labelled_csv
    rows = io.ingest_delimited(spark, path, os.path.join(d, "ingested"))
    assert rows.count() == 200 and rows.where(F.col("NL2_cor").isNotNull()).count() == 0
    mapping = {n: i for i, n in enumerate(LITHOLOGY_LABELS[:5])}
    paths = jobs.dataset_job(rows, "beschrijving", "HL_cor", mapping, os.path.join(d, "out"),
                             save_preprocessed=True, max_length=16)
    sets = io.load_split_sets(spark, paths["dataset"])
    assert sets.count() == 200 and set(sets.columns) == {"row_id", "text", "label", "split"}
    from textstrata.plans.jobs import pretrain_dataset_job
    mlm = pretrain_dataset_job(sets, os.path.join(d, "mlm"), max_length=16)
    assert spark.read.parquet(mlm["epoch0"]).count() == 200
    assert sets.where("split = 'test'").count() == 30            # ceil(0.15 * 200)
    weights = spark.read.parquet(os.path.join(paths["weights"], "table")).collect()
    assert {r["target"] for r in weights} == {"HL_cor"}
    assert abs(sum(r["n"] * r["weight"] for r in weights) - 170) < 1e-9
    text = spark.read.text(os.path.join(paths["weights"], "text")).first()["value"]
    assert len(text.split()) == 5
    tok = spark.read.parquet(paths["tokenized"])
    assert tok.count() == 200 and tok.select(F.size("input_ids").alias("n")).distinct().first()["n"] == 16


def test_train_batch_and_stream(spark, labelled_csv):
    d, path = labelled_csv
    rows = io.read_delimited(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    table = {n: i for i, n in enumerate(LITHOLOGY_LABELS)} | {"none": 9}
    rows = rows.select("row_id", "beschrijving",
                       *[F.try_element_at(F.create_map(*[x for k, v in table.items()
                                                         for x in (F.lit(k), F.lit(v))]),
                                          F.coalesce(F.col(c), F.lit("none"))).alias(c)
                         for c in ("HL_cor", "NL1_cor")]).withColumn("split", F.lit("train"))
    bundle = os.path.join(d, "bundle")
    jobs.train_job(rows, "beschrijving", {"HL_cor": "HL_cor", "NL1_cor": "NL1_cor"}, None, bundle, max_iter=5)
    texts = rows.select("row_id", "beschrijving")
    src = os.path.join(d, "stream_in")
    texts.write.mode("overwrite").parquet(src)
    batch = jobs.batch_predict_job(spark, spark.read.parquet(src), bundle, ["HL_cor", "NL1_cor"], table,
                                   os.path.join(d, "batch_out"))
    models = io.load_bundle(bundle, ["features", "HL_cor", "NL1_cor"])
    q = start_stream_predict(spark, src, texts.schema, models, ["HL_cor", "NL1_cor"], table,
                             os.path.join(d, "stream_out"), os.path.join(d, "ckpt"))
    q.awaitTermination()
    stream = spark.read.parquet(os.path.join(d, "stream_out"))
    cols = ["row_id", "HL_cor_label", "HL_cor_score", "NL1_cor_label", "NL1_cor_score"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, stream.select(cols).collect()))
    assert batch.count() == 200
    different = batch.where((F.col("HL_cor_label") == F.col("NL1_cor_label")) & (F.col("HL_cor_label") != "none"))
    assert different.count() == 0


def test_sweep_job(spark):
    d = tempfile.mkdtemp(prefix="textstrata-sweep-")
    rows = [(i, [0.7, 0.2, 0.1], [0.1, 0.8, 0.1], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, y int")
    out = jobs.sweep_job(df, {"A": "a", "B": "b"}, {"A": "y", "B": "y"}, {"x": 0, "y": 1, "none": 2}, d)
    assert out["sweep"].count() == 24 and out["wide"].count() == 12
    assert out["best"].first()["cutoff"] == pytest.approx(0.1)


def test_pretrain_dataset_job(spark):
    from textstrata.plans.jobs import pretrain_dataset_job
    d = tempfile.mkdtemp(prefix="textstrata-pretrain-")
    sets = spark.createDataFrame([(i, f"grijs zand met klei nummer {i} " * (i % 7 + 1), i % 3,
                                   "train" if i % 5 else "test") for i in range(60)],
                                 "row_id long, text string, label int, split string")
    paths = pretrain_dataset_job(sets, d, epochs=2, max_length=32)
    e0 = spark.read.parquet(paths["epoch0"])
    e1 = spark.read.parquet(paths["epoch1"])
    assert set(e0.columns) == {"row_id", "input_ids", "attention_mask", "special_tokens_mask", "labels", "split"}
    assert e0.count() == 60 and e0.where("split = 'test'").count() == 12
    l0 = {r["row_id"]: r["labels"] for r in e0.collect()}
    l1 = {r["row_id"]: r["labels"] for r in e1.collect()}
    assert l0 != l1                                   # each epoch draws again


def test_stream_restart_processes_only_new_files(spark, labelled_csv):
    d, path = labelled_csv
    rows = io.read_delimited(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    table = {n: i for i, n in enumerate(LITHOLOGY_LABELS)}
    lab = F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]),
                           F.col("HL_cor"))
    train_rows = rows.select("row_id", "beschrijving", lab.alias("HL_cor")).withColumn("split", F.lit("train"))
    models = jobs.train_job(train_rows, "beschrijving", {"HL_cor": "HL_cor"}, None,
                            os.path.join(d, "bundle_restart"), max_iter=3)
    texts = rows.select("row_id", "beschrijving")
    src, out, ckpt = (os.path.join(d, x) for x in ("restart_in", "restart_out", "restart_ckpt"))
    texts.where("row_id % 2 = 0").write.mode("append").parquet(src)
    start_stream_predict(spark, src, texts.schema, models, ["HL_cor"], table, out, ckpt).awaitTermination()
    first = spark.read.parquet(out).count()
    texts.where("row_id % 2 = 1").write.mode("append").parquet(src)
    start_stream_predict(spark, src, texts.schema, models, ["HL_cor"], table, out, ckpt).awaitTermination()
    streamed = spark.read.parquet(out)
    batch = jobs.predict_table(texts, models, ["HL_cor"], table)
    assert first == 100 and streamed.count() == 200
    cols = ["row_id", "HL_cor_label", "HL_cor_score"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_tune_cutoffs_job(spark, labelled_csv):
    from textstrata.plans.jobs import tune_cutoffs_job
    d, path = labelled_csv
    rows = io.read_delimited(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    table = {n: i for i, n in enumerate(LITHOLOGY_LABELS)} | {"none": 9}
    tmap = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    lab = rows.select("row_id", F.col("beschrijving").alias("text"),
                      F.try_element_at(tmap, F.col("HL_cor")).alias("HL"),
                      F.try_element_at(tmap, F.col("NL1_cor")).alias("NL1")).withColumn("split", F.lit("train"))
    jobs.train_job(lab, "text", {"HL": "HL", "NL1": "NL1"}, None, os.path.join(d, "tune_bundle"), max_iter=3)
    tests = {"HL": lab.select("text", F.col("HL").alias("label")),
             "NL1": lab.select("text", F.col("NL1").alias("label"))}
    out = tune_cutoffs_job(spark, os.path.join(d, "tune_bundle"), tests, table, os.path.join(d, "tune"))
    assert out["sweep"].count() == 24 and out["best"].count() == 1


def test_bundle_classifier(spark, labelled_csv):
    from textstrata.plans.classifier import BundleClassifier
    d, path = labelled_csv
    rows = io.read_delimited(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    table = {n: i for i, n in enumerate(LITHOLOGY_LABELS)} | {"none": 9}
    tmap = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    lab = rows.select("row_id", F.col("beschrijving").alias("text"),
                      *[F.try_element_at(tmap, F.coalesce(F.col(c), F.lit("none"))).alias(c)
                        for c in ("HL_cor", "NL1_cor", "NL2_cor")]).withColumn("split", F.lit("train"))
    bundle = os.path.join(d, "clf_bundle")
    jobs.train_job(lab, "text", {c: c for c in ("HL_cor", "NL1_cor", "NL2_cor")}, None, bundle, max_iter=3)
    clf = BundleClassifier.from_directory(bundle)
    texts = spark.createDataFrame([("grind met wat klei nr 3",), ("veen",)], "text string")
    out = clf(texts, cutoff=0.1).collect()
    assert len(out) == 2 and {"HL_cor_label", "NL2_cor_score"} <= set(out[0].asDict())
    ranked = clf.scores(texts).first()["HL_cor_ranked"]
    assert len(ranked) == 10 and ranked[0]["score"] >= ranked[-1]["score"]
    with pytest.raises(FileNotFoundError):
        BundleClassifier.from_directory(bundle, targets=["HL_cor", "missing"])


def test_clean_job_writes_the_chain(spark):
    from textstrata.operators import clean
    d = tempfile.mkdtemp(prefix="textstrata-clean-")
    rows = [(1.0, 2.0, 1, "grijs zand"), (1.0, 2.0, 2, "idem met klei"), (1.0, 2.0, 3, "van 1 tot 2 m zand van 2 tot 3 m klei"),
            (5.0, 5.0, 4, "le sable et la mer dans une"), (5.0, 5.0, 5, "idem")]
    df = spark.createDataFrame(rows, "x double, y double, row_id long, beschrijving string")
    out = jobs.clean_job(df, ["x", "y"], "row_id", "beschrijving", os.path.join(d, "clean"))
    expect = clean.clean_chain(df, ["x", "y"], "row_id", "beschrijving")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expect.collect()))
    got = {r["row_id"]: r["beschrijving"] for r in out.collect()}
    assert got == {1: "grijs zand", 2: "grijs zand met klei"}   # interval row dropped; French site dropped
