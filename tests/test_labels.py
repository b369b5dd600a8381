"""Label tables and mapping."""
import pytest
from pyspark.errors import PySparkException

from textstrata.operators.labels import (id_to_label, label2id, label_to_id, labels_by_first_seen,
                                         map_labels)


def test_label_to_id_unmapped_is_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("zz",)], "l string")
    got = [r["id"] for r in map_labels(df, "l", label2id(["a", "b"]), "id").collect()]
    assert got == [0, 1, None, None]


def test_id_to_label_unknown_fails(spark):
    df = spark.createDataFrame([(0,), (1,)], "i int")
    assert [r["n"] for r in df.select(id_to_label("i", {"x": 0, "y": 1}).alias("n")).collect()] == ["x", "y"]
    bad = spark.createDataFrame([(5,)], "i int")
    with pytest.raises(PySparkException):
        bad.select(id_to_label("i", {"x": 0}).alias("n")).collect()


def test_first_seen_with_missing_label(spark):
    df = spark.createDataFrame([(3, "b"), (1, None), (2, "a"), (5, "a"), (0, "c")], "row_id int, l string")
    got = {r["label"]: r["label_id"] for r in labels_by_first_seen(df, "l", "row_id").collect()}
    assert got == {"c": 0, None: 1, "a": 2, "b": 3}


def test_with_none_appends_next_id():
    assert label2id(["a", "b"], with_none=True) == {"a": 0, "b": 1, "none": 2}
    assert label2id({"x": 4}, with_none=True) == {"x": 4, "none": 5}


def test_label_to_id_column(spark):
    df = spark.createDataFrame([(1,)], "v int")
    assert df.select(label_to_id("v", {"1": 7}).alias("x")).first()["x"] == 7


def test_target_label_table(spark):
    from textstrata.operators.labels import target_label_table
    rows = target_label_table(spark).collect()
    per = {}
    for r in rows:
        per.setdefault(r["target"], {})[r["label"]] = r["label_id"]
    assert len(per["HL_cor"]) == 9 and per["NL1_cor"]["none"] == 9 and per["NL2_cor"]["silt"] == 8
