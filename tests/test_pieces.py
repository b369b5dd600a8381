"""Content ids from a table of word pieces: against the greedy word-piece model of a public library."""
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textstrata.operators import encode, stats
from textstrata.plans import jobs

PIECES = ["un", "##able", "##aff", "##a", "af", "a", "##f", "zand", "##ig", "##g", "klei", "é", "##é", "##x"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(PIECES)] + [("zand", 99), (None, 5), ("un", None)], "piece string, id int")


def test_edges(spark, vocabulary):
    texts = ["unaffable zandig", "", None, " \t\n", "zandig zandig", "zandq unaffable", "é" * 100, "é" * 101, "##x é", "zand klei klei"]
    rows = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.id, list(r.ids)) for r in encode.piece_ids(rows.drop("ids"), "text", ["id"], vocabulary, unknown_id=0).collect()]
    want = [(0, [1, 3, 2, 8, 9]), (1, []), (2, []), (3, []), (4, [8, 9, 8, 9]), (5, [0, 1, 3, 2]), (6, [12] + [13] * 99), (7, [0]),
            (8, [14, 12]), (0, [0, 11])]
    assert sorted(got) == sorted(want)
    out = encode.piece_ids(rows, "text", ["id"], vocabulary, 0, out_col="n")
    assert sorted((r.id, list(r.n)) for r in out.collect()) == sorted(want)
    assert encode.piece_ids(rows.where("false"), "text", ["id"], vocabulary, 0).count() == 0
    nothing_known = encode.piece_ids(rows, "text", ["id"], vocabulary.where("false"), 7).where("id = 4").first()
    assert list(nothing_known.ids) == [7, 7]


def test_rows_equal_a_library(spark):
    """Whole documents of the smallest tables; the library gets the vocabulary given, nothing is trained."""
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    words = sorted({w for r in docs.where("doc_id % 7 = 0").collect() for w in r.text.split()})
    pieces = sorted({p for w in words for n in (1, 2, 3, len(w)) for p in (w[:n], "##" + w[:n], "##" + w[-n:])} | {"[UNK]"})
    ids = {p: i for i, p in enumerate(pieces)}
    model = tokenizers.models.WordPiece(vocab=ids, unk_token="[UNK]", max_input_chars_per_word=100)
    table = spark.createDataFrame(list(ids.items()), "piece string, id int")
    got = {r.doc_id: list(r.ids) for r in encode.piece_ids(docs, "text", ["doc_id"], table, ids["[UNK]"]).collect()}
    known = {}
    for r in docs.collect():
        want = []
        for w in encode_words(r.text):
            known.setdefault(w, [t.id for t in model.tokenize(w)])
            want += known[w]
        assert got[r.doc_id] == want, r.doc_id
    assert len(known) > 500 and sum(v == [ids["[UNK]"]] for v in known.values()) < len(known)


def encode_words(text):
    import re
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_truncation_keeps_the_first_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, "unaffable " * 2000)], "id long, text string")
    whole = encode.piece_ids(rows, "text", ["id"], vocabulary, 0).first().ids
    cut = encode.pad_ids(encode.piece_ids(rows, "text", ["id"], vocabulary, 0, max_words=510), ["id"]).first().input_ids
    assert len(whole) == 6000 and cut[1:511] == whole[:510]


def test_jobs_take_a_table_of_pieces(spark, vocabulary, tmp_path):
    rows = spark.createDataFrame([(i, "zandig klei" if i % 2 else "klei", "train" if i else "test") for i in range(4)], "row_id long, text string, split string")
    paths = jobs.pretrain_dataset_job(rows, str(tmp_path), pieces=vocabulary, unknown_id=0)
    stored = spark.read.parquet(str(tmp_path / "encoded"))
    assert sorted((r.row_id, r.input_ids[1:-1]) for r in stored.collect()) == [(0, [11]), (1, [8, 9, 11]), (2, [11]), (3, [8, 9, 11])]
    assert spark.read.parquet(paths["epoch0"]).count() == 4


def test_plans_hold_no_python(spark, vocabulary):
    rows = spark.createDataFrame([(1, "zandig")], "id long, text string")
    plan = encode.piece_ids(rows, "text", ["id"], vocabulary, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_metrics_refuse_rows_without_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None)], "t string, p string")
    for one, other in (("t", "p"), ("p", "t")):
        with pytest.raises(Exception, match="no true or no predicted label"):
            stats.classification_metrics(df, one, other).collect()
    assert stats.classification_metrics(df.where("p is not null"), "t", "p").first().accuracy == 1.0
