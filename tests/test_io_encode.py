"""IO1-IO7 round trips and E1-E3 invariants."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textstrata.operators import encode
from textstrata.sources import io


def test_read_delimited_na_and_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="textstrata-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write('row;beschrijving;HL_cor\n1;"grijs\nzand";klei\n2;NA;None\n3;;n/a\n4;"a;b";NULL\n')
    df = io.read_delimited(spark, path, "row int, beschrijving string, HL_cor string")
    got = {r["row"]: (r["beschrijving"], r["HL_cor"]) for r in df.collect()}
    assert got == {1: ("grijs\nzand", "klei"), 2: (None, None), 3: (None, None), 4: ("a;b", None)}


def test_write_read_round_trip_and_splits(spark):
    d = tempfile.mkdtemp(prefix="textstrata-io-")
    rows = [(1, 'he said "x"; then\nleft', 0, "train"), (2, " padded ", 1, "test"), (3, "z", 1, "NOT_SET")]
    df = spark.createDataFrame(rows, "row_id long, text string, label int, split string")
    io.write_delimited(df, os.path.join(d, "csv"))
    back = io.read_delimited(spark, os.path.join(d, "csv"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    io.write_split_sets(df, os.path.join(d, "sets"), "text", "label")
    test = io.load_split_sets(spark, os.path.join(d, "sets"), "test").collect()
    assert [(r["text"], r["label"]) for r in test] == [(" padded ", 1)]
    assert io.load_split_sets(spark, os.path.join(d, "sets")).count() == 2   # NOT_SET left out


def test_weights_text_format(spark):
    w = spark.createDataFrame([(1, 2.5), (0, 0.3333333333)], "label_id int, weight double")
    assert io.weights_text(w).first()["value"] == "   0.33333    2.50000"


def test_bundle_missing_directory(spark):
    with pytest.raises(FileNotFoundError):
        io.load_bundle(tempfile.mkdtemp(prefix="textstrata-bundle-"), ["HL_cor"])


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["Grijs kleiig zand, zeer fijn, met enkele grindjes", "", None, "woord " * 2000]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_encode_padded(spark, docs):
    rows = {r["id"]: r for r in encode.encode_padded(docs, "text", ["id"], max_length=32).collect()}
    for r in rows.values():
        assert len(r["input_ids"]) == 32 and len(r["attention_mask"]) == 32
        k = sum(r["attention_mask"])
        assert r["input_ids"][0] == 49406 and r["input_ids"][k - 1] == 49407
        assert all(x == 0 for x in r["input_ids"][k:])
    assert sum(rows[3]["attention_mask"]) == 32          # long text truncated
    assert sum(rows[1]["attention_mask"]) == 2           # empty text: start + end


def test_mask_tokens_invariants(spark, docs):
    enc = encode.encode_variable(docs, "text", ["id"], max_length=512)
    masked = encode.mask_tokens(enc, "id", mask_id=49408, vocab_size=49408, seed=1)
    orig = {r["id"]: r["input_ids"] for r in enc.collect()}
    chosen = total = 0
    for r in masked.collect():
        o, m, lab, sp = orig[r["id"]], r["input_ids"], r["labels"], r["special_tokens_mask"]
        assert len(o) == len(m) == len(lab) == len(sp)
        for x, y, l, s in zip(o, m, lab, sp):
            if l == -100:
                assert x == y                       # unchosen ids unchanged
            else:
                assert s == 0 and l == x            # special positions never chosen
                chosen += 1
            total += s == 0
    assert 0.10 < chosen / total < 0.20
    again = encode.mask_tokens(enc, "id", mask_id=49408, vocab_size=49408, seed=1)
    assert sorted(map(tuple, masked.select("id", F.col("labels").cast("string")).collect())) == \
        sorted(map(tuple, again.select("id", F.col("labels").cast("string")).collect()))


def test_inference_after_missing_values(spark):
    d = tempfile.mkdtemp(prefix="textstrata-infer-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("x;y;t\n1;2.5;a\nNA;;b\n3;nan;NA\n")
    df = io.read_delimited(spark, path)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"x": "bigint", "y": "double", "t": "string"}
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 2.5, "a"), (None, None, "b"), (3, None, None)], key=str)
