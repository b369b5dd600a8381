import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs, sf001_docs  # noqa: F401  fixtures
from textstrata.llm import mixing, packing


def targets(spark, sizes, weights=None):
    rows = [(str(s), [s], n) for s, n in sizes.items()]
    table = mixing.source_table(spark.createDataFrame(rows, "pattern string, members array<string>, mass long"), weights)
    return {r.source: r.target for r in table.collect()}


def brute_targets(sizes, weights):
    """One source after another is capped, until no share is above three times its source."""
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        whole = sum(w for s, w in weights.items() if s not in capped)
        over = [s for s in sizes if s not in capped and rest * weights[s] / whole > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, rest * weights[s] / (whole or 1)) for s in sizes}
        capped[over[0]] = 3 * sizes[over[0]]


def test_targets_are_capped_and_reshared(spark):
    assert targets(spark, {"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 2}) == {"a": 30, "b": 60, "c": 120}
    assert targets(spark, {"a": 0, "b": 5}, {"a": 1, "b": 1}) == {"a": 0, "b": 5}
    assert targets(spark, {}) == {} and targets(spark, {"a": 0, None: 0}) == {"a": 0, None: 0}
    rng = random.Random(7)
    for _ in range(3):
        sizes = {s: rng.choice([0, 1, 5, 50, 1000, 10_000]) for s in ["a", "b", "B", "é", "\U0001f600", "\uffff", "z1", "z2"]} | {None: 40}
        order = sorted(s for s in sizes if s is not None) + [None]
        want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
        assert targets(spark, sizes) == pytest.approx(want)


def brute_flow(patterns, quota):
    """Largest total, then least repetition cost, over all integer splits."""
    keys = sorted(patterns)
    best = None
    for split in itertools.product(*[itertools.product(*[range(quota[s] + 1) for s in patterns[k][0]]) for k in keys]):
        used, cost = Counter(), 0
        ok = True
        for k, parts in zip(keys, split):
            total = sum(parts)
            ok &= total <= 3 * patterns[k][1]
            cost += sum(min(max(total - tier * patterns[k][1], 0), patterns[k][1]) * tier for tier in range(3))
            for s, x in zip(patterns[k][0], parts):
                used[s] += x
        if ok and all(used[s] <= quota[s] for s in quota):
            key = (-sum(used.values()), cost)
            best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_equals_brute_force(seed):
    rng = random.Random(seed)
    patterns = {"A": (("a",), rng.randrange(3)), "AB": (("a", "b"), rng.randrange(3)), "B": (("b",), rng.randrange(3))}
    quota = {"a": rng.randrange(5), "b": rng.randrange(5)}
    taken = mixing.route(patterns, quota)
    cost = sum(min(max(taken[k] - tier * patterns[k][1], 0), patterns[k][1]) * tier for k in patterns for tier in range(3))
    assert (-sum(taken.values()), cost) == brute_flow(patterns, quota)


def mixed(docs):
    units, table = mixing.mix(docs)
    rows = mixing.with_copies(docs, units, "doc_id", "text", name="taken_copies").withColumn("words", mixing.word_count(F.col("text")))
    return rows.select("doc_id", "text", "source", "words", "taken_copies").collect(), {r.source: r for r in table.collect()}


@pytest.mark.parametrize("table", ["odd_docs", "sf001_docs"])
def test_mix_meets_its_targets(request, table):
    docs = request.getfixturevalue(table)
    rows, sources = mixed(docs)
    assert len(rows) == docs.count()
    taken, size, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.words == len((r.text or "").encode().split()) and 0 <= r.taken_copies <= 3
        assert r.words or not r.taken_copies
        taken[r.source] += r.words * r.taken_copies
        size[r.source] += r.words
        longest[r.source] = max(longest[r.source], r.words)
    assert size == {s: r.source_size for s, r in sources.items()}
    assert sum(r.target for r in sources.values()) == pytest.approx(sum(size.values()))
    for s, r in sources.items():
        assert taken[s] <= r.target + 1 and taken[s] >= r.target - longest[s] - 1
    again, _ = mixed(docs.repartition(5))
    assert sorted((str(r.doc_id), str(r.text), r.taken_copies) for r in rows) == sorted((str(r.doc_id), str(r.text), r.taken_copies) for r in again)
    units, _ = mixing.mix(docs)
    repeated = mixing.repeat_rows(docs, units)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.taken_copies for r in rows)


def test_selection_equals_a_plain_first_fit(spark):
    """Rounds go on until no document that is left out fits what is left of its source."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * rng.choice([2, 3, 10, 400, 401 + i]), "s0" if i % 3 else "s1") for i in range(600)], "doc_id long, text string, source string")
    rows, sources = mixed(docs)
    for s, r in sources.items():
        whole, rest = divmod(min(round(r.target), 3 * r.source_size), r.source_size)
        mine = [x for x in rows if x.source == s]
        left = rest - sum(x.words * (x.taken_copies - whole) for x in mine)
        out = [x.words for x in mine if x.taken_copies == whole]
        assert {x.taken_copies - whole for x in mine} <= {0, 1} and 0 <= left and all(n > left for n in out)


def test_single_sources_equal_the_flow(spark):
    """Sources without overlap by formula, overlapping ones by the network: the same as one network of all."""
    rng = random.Random(9)
    for _ in range(3):
        sets = [("a",), ("b",), ("c",), ("d",), ("c", "d"), (None,)]
        masses = {str(m): (m, rng.randrange(1, 200)) for m in sets}
        table = spark.createDataFrame([(k, list(m), n) for k, (m, n) in masses.items()], "pattern string, members array<string>, mass long")
        sources = mixing.source_table(table)
        quota = {r.source: r.target for r in sources.collect()}
        got = {r.pattern: r.flow for r in mixing._flows(table, sources, 3).collect()}
        assert got == mixing.route(masses, {s: quota[s] for s in sorted((s for s in quota if s), key=str) + [None]})


def test_documents_of_no_source_are_not_taken(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "a b", []), (3, "a b", ["x"])], "doc_id long, text string, member array<string>")
    units, _ = mixing.mix(docs, sources=F.col("member"))
    got = mixing.with_copies(docs, units, "doc_id", "text", F.col("member")).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == [(1, 0), (2, 0), (3, 3)]


def test_overlapping_sources(spark, no_docs):
    docs = spark.createDataFrame([(i, "w " * 10, [["a"], ["b"], ["a", "b"]][i % 3]) for i in range(300)], "doc_id long, text string, member array<string>")
    units, table = mixing.mix(docs, sources=F.col("member"), weights={"a": 3, "b": 1})
    taken = units.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert taken == pytest.approx(3000, abs=60)
    units, table = mixing.mix(no_docs)
    assert units.count() == table.count() == 0


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_equal_brute_force(seed):
    rng = random.Random(seed)
    longest = rng.choice([12, 700, 40_000])  # no length is a bin of others
    lengths = [rng.randrange(longest) for _ in range(rng.randrange(1, 30 if longest == 12 else 16))]
    have = Counter(lengths)
    keys = sorted(have)
    k = rng.randrange(1, 5)
    got = packing.optimal_boundaries(keys, [have[x] for x in keys], k)
    best = min(padding(lengths, (*c, keys[-1])) for n in range(min(k, len(keys))) for c in itertools.combinations(keys[:-1], n))
    assert len(got) <= k and got[-1] == keys[-1] and padding(lengths, got) == best


@pytest.mark.parametrize("shard_rows", [20_000, 7])
def test_batches_hold_the_budget(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    rng = random.Random(1)
    lengths = [rng.choice([3, 5, 5, 40, 600, 1500, 5000]) for _ in range(400)] + [0, 0]
    docs = spark.createDataFrame([(i % 300, n) for i, n in enumerate(lengths)], "doc_id long, n int").withColumn("text", F.lit(None).cast("string")).withColumn("bucket", F.lit("clash"))
    rows = packing.pack(docs, length=F.col("n"), buckets=4, token_budget=2000).collect()
    assert sorted((r.id, r.n_tokens) for r in rows) == sorted((i % 300, n) for i, n in enumerate(lengths))
    by = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.pad_to
        by[r.bucket, r.batch].append(r)
    for (bucket, batch), rs in by.items():
        room = max(1, 2000 // max(1, rs[0].pad_to))
        last = batch == max(b for k, b in by if k == bucket)
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and (len(rs) == room or last and len(rs) < room)
    assert {b for k, b in by if k == 0} == set(range(max(b for k, b in by if k == 0) + 1))


def test_packing_of_odd_tables(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert len(rows) == odd_docs.count() and max(r.n_tokens for r in rows) == 30_000
    assert packing.pack(no_docs).count() == 0


def test_boundaries_of_many_lengths_equal_the_plain_program():
    rng = random.Random(1)
    keys = sorted(rng.sample(range(60_000), 900))
    counts = [rng.randrange(1, 50) for _ in keys]
    k = 9
    best = [0.0] + [float("inf")] * len(keys)
    for _ in range(k):
        now = [float("inf")] * (len(keys) + 1)
        for j in range(1, len(keys) + 1):
            pad = 0
            for i in range(j - 1, -1, -1):
                pad += counts[i] * (keys[j - 1] - keys[i])
                if pad >= now[j]:
                    break
                now[j] = min(now[j], best[i] + pad)
        best = now
    bounds = packing.optimal_boundaries(keys, counts, k)
    got = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(keys, counts))
    assert got == best[-1] and len(bounds) <= k
