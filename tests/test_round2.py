"""Numbers with suffixes stay text; nothing is dropped silently; caches are released."""
import pytest
from pyspark.sql import functions as F

from textstrata.operators import order, sample, stats, train
from textstrata.sources import io


def test_suffixed_codes_stay_text(spark):
    df = spark.createDataFrame([("10D", "1", "1.5"), ("12F", "-2", "2e3"), ("7", None, "3")], "a string, b string, c string")
    out = io.infer_numeric(df)
    assert dict(out.dtypes) == {"a": "string", "b": "bigint", "c": "double"}
    assert [r.a for r in out.orderBy("a").collect()] == ["10D", "12F", "7"]


def test_rows_in_the_loss_are_the_rows_counted(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, 0.0], 0), ([3.0, 0.0], None)], "logits array<double>, y int")
    assert stats.argmax_accuracy(df, "logits", "y").first().n == 2
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label_id int, weight double")
    assert stats.weighted_cross_entropy(df, "logits", "y", weights).first().n == 2
    with pytest.raises(Exception, match="no weight for label 1"):
        stats.weighted_cross_entropy(df, "logits", "y", weights.where("label_id = 0")).collect()


def test_weight_tables_have_no_cap(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1)], "logits array<double>, y int")
    weights = spark.range(1500).select(F.col("id").cast("int").alias("label_id"), F.lit(1.0).alias("weight"))
    assert stats.weighted_cross_entropy(df, "logits", "y", weights).first().n == 1


def test_group_sizes_in_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "k string")
    assert [(r.k, r["count"]) for r in sample.group_sizes_ordered(df, ["k"]).collect()] == [("a", 1), ("c", 1), ("b", 2)]


def test_training_releases_its_caches(spark):
    rows = spark.createDataFrame([(f"sand clay {i % 2}", i % 2) for i in range(20)], "text string, y int")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    train.best_run(rows, rows, "text", {"t": "y"}, [{"max_iter": 1}, {"max_iter": 2}], num_features=64)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_missing_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.load_bundle(str(tmp_path / "none"), ["t"])


def test_row_ids_follow_file_name_and_position(spark, tmp_path):
    """Small and large files, several pieces per file: ids run in file order."""
    sizes = {"a": 1, "b": 900, "c": 40}
    for name, n in sizes.items():
        lines = "\n".join(f"{name}{i};{i}" for i in range(n))
        (tmp_path / f"{name}.csv").write_text(f"k;v\n{lines}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = io.ingest_delimited(spark, str(tmp_path / "*.csv"), str(tmp_path / "out"))
        got = [r.k for r in out.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    assert [r.row_id for r in out.orderBy("row_id").collect()] == list(range(941))
    assert dict(out.dtypes)["v"] == "bigint"


def test_one_site_of_many_rows_is_many_groups(spark):
    """A site with positions 0..n-1 is cut into chunks, the chunks into blocks."""
    n = 4000
    rows = [("hot", i, "zand" if i % 1500 == 0 else "idem") for i in range(n)] + [("s", i, f"klei {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "site string, ord long, text string")
    got = order.expand_idem(df, ["site"], "ord", "text", chunk_width=10)
    assert {r.text for r in got.where("site = 'hot'").collect()} == {"zand"}
    assert got.where("idem_unresolved").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_row_without_a_label_fails_the_confusion_matrix(spark):
    df = spark.createDataFrame([("a", "b"), (None, "a")], "t string, p string")
    with pytest.raises(Exception, match="row without a label in t"):
        stats.confusion_counts(df, "t", "p").collect()


def test_confusion_matrix_of_1001_labels(spark):
    df = spark.range(1001).select(F.col("id").alias("t"), F.col("id").alias("p"))
    cells = stats.confusion_counts(df, "t", "p", normalize="all")
    assert cells.agg(F.count("*"), F.sum("n"), F.round(F.sum("value"), 9)).first()[:] == (1001 * 1001, 1001, 1.0)
