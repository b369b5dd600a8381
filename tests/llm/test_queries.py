"""Registered queries: SQL where there is some, else properties over the small tables; the pipeline's stages."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF001, SF01
from oracle_compare import compare, duck
from textstrata.llm import simhash
from textstrata.llm.oracle import ORACLE_SQL
from textstrata.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    problems, n = compare(spark, duck(SF01), name, QUERIES[name], ORACLE_SQL[name], SF01)
    assert not problems and n


def test_all_are_registered():
    assert set(QUERIES) <= set(E.queries()) and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n.startswith("op")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing", "packing"]


def held_out_accuracy(spark, name, label):
    rows = QUERIES[name](spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    return rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_classifiers_hold_out(spark):
    assert held_out_accuracy(spark, "op8_quality", "quality") > 0.95
    assert held_out_accuracy(spark, "op2_toxicity", "toxic") > 0.9


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001).persist()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            toxic = {r.doc_id for r in QUERIES["op2_toxicity"](spark, SF001).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - toxic
        if name == "simhash near-dedup":
            groups = simhash.near_groups(docs).collect()
            assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})
        if name == "secret scans":
            assert out.count() == docs.count() and not out.where("n_chars <> length(text)").count()
        docs = out
