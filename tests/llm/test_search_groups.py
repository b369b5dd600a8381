import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import fingerprint, groups
from odd_tables import no_docs, odd_docs  # noqa: F401  fixtures
from textstrata.llm import simhash, topk
from textstrata.llm.components import components


def brute_top(vectors, k):
    out = {}
    for q, x in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("n,dim,blocks", [(130, 8, (16, 3)), (15, 3, (4096, 1024)), (1, 2, (4, 4))])
def test_top_k_equals_brute_force(spark, n, dim, blocks):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]  # many ties
    rows[0] = (0, [0.0] * dim)
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 20 == 0, k=20, candidate_block=blocks[0], query_block=blocks[1]).collect()
    want = [(q, r + 1, i, s) for q, best in brute_top(rows, 20).items() for r, (i, s) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted(want)


def test_pivots_stop_early_on_clustered_vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 50
    x = np.round(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)))
    radius = float(np.sqrt((x ** 2).sum(axis=1).max())) * (1 + 1e-12)
    pivots = topk.choose_pivots(x[:200], radius, 16)
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)
    q = x[:10]
    found = topk.search_block(np.arange(10), q, topk._distances(topk._query_points(q, radius), pivots), np.arange(2000), x.view(Counted), topk._distances(topk._augmented(x, radius), pivots), radius, 20)
    assert sum(seen) < 10 * 2000 * 0.8
    for i in range(10):
        s = x @ x[i]
        want = sorted(((-s[j], j) for j in range(2000) if j != i))[:20]
        assert [(c, v) for a, c, v in found if a == i] == [(j, -v) for v, j in want]


def test_vectors_with_holes_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [3.0, 4.0, 5.0]), (5, [3.0, 4.0, 5.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    clean = topk.clean_vectors(df, "vec_id", "embedding")
    assert sorted(r.id for r in clean.collect()) == [0, 5, 5, 6]
    got = topk.top_k(clean, F.col("id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == [(0, 1, 5, 11.0), (0, 2, 5, 11.0), (0, 3, 6, 0.0)]
    assert topk.top_k(clean.where("false"), F.col("id") == 0).count() == 0


def test_rows_with_one_id_are_candidates_and_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [5.0, 0.0]), (1, [2.0, 9.0]), (2, [3.0, 0.0])]
    for blocks in ((4096, 1024), (2, 1)):
        got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 20 == 0, k=3, candidate_block=blocks[0], query_block=blocks[1]).collect()
        # the query row (1, 0) first meets (5, 0); (0, 2) first meets (2, 9)
        assert sorted((r["rank"], r.id, r.score) for r in got) == sorted([(1, 1, 5.0), (2, 2, 3.0), (3, 1, 2.0), (1, 1, 18.0), (2, 1, 0.0), (3, 2, 0.0)])


def test_fingerprints_equal_the_contract(odd_docs):
    rows = {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}
    got = {(r.id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(odd_docs).collect()}
    assert got == {(i, fingerprint(t)) for i, t in rows}


def test_slices_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(random.Random(1).choices("a b c d e f".split(), k=999)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == whole


def fake_fps(seed=3):
    """Exact copies, chains of one and two bits, near misses of three bits, one dense cluster."""
    rng = random.Random(seed)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        fps += [f] * rng.choice([1, 1, 2, 5])
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
            fps.append(f)
    core = rng.getrandbits(64)
    fps += [core ^ rng.getrandbits(10) << 3 for _ in range(400)]
    return [(rng.randrange(5000) * 2 + 1, f) for f in fps]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_lose_nothing(spark, bits, monkeypatch):
    rows = [(i, f) for i, (_, f) in enumerate(fake_fps(bits))]
    distinct = sorted({f for _, f in rows})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in distinct]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bits)
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 64 for r in edges.collect())
    roots = {r.node & (1 << 64) - 1: r.root for r in components(edges).collect()}
    want = groups([(i, f) for i, f in enumerate(distinct)], bits)
    got = [roots.get(f, f - (1 << 64) if f >> 63 else f) for f in distinct]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_groups_of_documents(spark, odd_docs, no_docs):
    got = [(r.id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(odd_docs).collect()]
    rows = [(i, f) for i, f, _ in got]
    assert [c for _, _, c in got] == groups(rows)
    assert len(got) == odd_docs.count()
    assert simhash.near_groups(no_docs).count() == 0


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    want = {c for c in groups([(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()])}
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert simhash.keep_one_per_group(no_docs).count() == 0


def test_every_group_keeps_one_row(spark):
    """Ids that repeat with texts of different groups, and groups of null ids only."""
    prose = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    a, b, c, d, e = map(prose, "abcde")
    ids_and_texts = {
        "text of 7 in the group of 3": [(3, a), (7, a), (7, b), (9, b)],
        "7 names both groups": [(7, a), (7, b), (9, a), (8, b)],
        "null ids beside an id": [(None, c), (None, c), (5, d), (None, d), (None, d)],
        "near copies without an id": [(None, e), (None, e + " ")],
        "a tie of texts": [(4, a + " "), (4, a), (None, None), (None, "")],
    }
    want = {"text of 7 in the group of 3": [(3, a), (7, b)], "7 names both groups": [(7, a), (7, b)], "null ids beside an id": [(5, d), (None, c)],
            "near copies without an id": [(None, e)], "a tie of texts": [(4, a), (None, None)]}
    assert len({fingerprint(t) for t in (a, b, c, d, e)}) == 5
    for case, rows in ids_and_texts.items():
        docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
        kept = simhash.keep_one_per_group(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want[case], key=str), case


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(9, i) for i in range(1000, 1300)] + [(7, 7), (5, 6), (6, 5), (5, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {9: 9} | {i: 9 for i in range(1000, 1300)} | {7: 7, 5: 5, 6: 5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
