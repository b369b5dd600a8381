"""Queries without a SQL oracle, against brute force on the smallest tables.

Tokenisation is compared with a direct call of the tokenizer library;
masking with a pure-Python replay of its hash draws (Spark's ``xxhash64`` is
XXH64 chained over the little-endian values, seed 42).
"""
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as E
from conftest import SF001
from textstrata.operators.encode import default_vocabulary

START, END, MAX = 49406, 49407, 512


@pytest.fixture(scope="module")
def expected_ids():
    docs = pq.read_table(f"{SF001}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    tok = Tokenizer.from_file(default_vocabulary())
    enc = tok.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)
    return {d["doc_id"]: [START, *e.ids[:MAX - 2], END] for d, e in zip(docs, enc)}


def test_encode_padded_matches_tokenizer(spark, expected_ids):
    got = {r["doc_id"]: r for r in E.queries()["encode_padded"](spark, SF001).collect()}
    assert got.keys() == expected_ids.keys()
    for k, ids in expected_ids.items():
        assert got[k]["input_ids"] == ids + [0] * (MAX - len(ids))
        assert got[k]["attention_mask"] == [1] * len(ids) + [0] * (MAX - len(ids))


def test_encode_variable_matches_tokenizer(spark, expected_ids):
    got = {r["doc_id"]: r for r in E.queries()["encode_variable"](spark, SF001).collect()}
    for k, ids in expected_ids.items():
        assert got[k]["input_ids"] == ids
        assert got[k]["special_tokens_mask"] == [1] + [0] * (len(ids) - 2) + [1]


def _u(seed, epoch, salt, key, pos):
    h = 42
    for v, n in ((seed, 4), (epoch, 4), (salt, 4), (key, 8), (pos, 4)):
        h = xxhash.xxh64_intdigest(v.to_bytes(n, "little", signed=True), seed=h)
    return (h >> 11) * 2.0 ** -53


def test_mask_tokens_replays_in_python(spark, expected_ids):
    got = {r["doc_id"]: r for r in E.queries()["mask_tokens"](spark, SF001).collect()}
    seed, epoch, vocab, mask_id = 2023, 0, 49408, 49408
    for k, ids in expected_ids.items():
        special = [1] + [0] * (len(ids) - 2) + [1]
        inputs, labels = [], []
        for i, (x, s) in enumerate(zip(ids, special)):
            chosen = s == 0 and _u(seed, epoch, 1, k, i) < 0.15
            u2 = _u(seed, epoch, 2, k, i)
            new = mask_id if u2 < 0.8 else (int(_u(seed, epoch, 3, k, i) * vocab) if u2 < 0.9 else x)
            inputs.append(new if chosen else x)
            labels.append(x if chosen else -100)
        assert got[k]["input_ids"] == inputs
        assert got[k]["labels"] == labels


def test_batch_predict_picks_match_python_rule(spark, tmp_path_factory):
    from textstrata.operators import train
    from textstrata.plans import bindings as B
    from textstrata.plans import jobs
    from textstrata.sources import io

    path, _ = B._bundle(spark, SF001, save=True)
    texts = B.read(spark, SF001, "documents").select("doc_id", "text")
    out = jobs.batch_predict_job(spark, texts, path, B.MODEL_TARGETS, B.TOXIC,
                                 str(tmp_path_factory.mktemp("pred")), cutoff=0.1)
    models = io.load_bundle(path, ["features", *B.MODEL_TARGETS])
    scored = train.score(texts, models, B.MODEL_TARGETS, len(B.TOXIC)).collect()
    names = {v: k for k, v in B.TOXIC.items()}
    expected = {}
    for r in scored:
        taken, picks = [], []
        for t in B.MODEL_TARGETS:
            s = r[f"s_{t}"]
            cand = [i for i in sorted(range(len(s)), key=lambda i: (-s[i], i))
                    if s[i] >= 0.1 and names[i] not in taken]
            if cand:
                picks += [names[cand[0]], s[cand[0]]]
                taken.append(names[cand[0]])
            else:
                picks += ["none", -1.0]
        expected[r["doc_id"]] = tuple(picks)
    got = {r["doc_id"]: (r["quality_label"], r["quality_score"], r["toxic_label"], r["toxic_score"])
           for r in out.collect()}
    assert got == expected
