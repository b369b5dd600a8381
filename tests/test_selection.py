"""S4 minority-first selection against a brute-force walk of the rule."""
import hashlib

import pytest

from textstrata.operators import sample


def h(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def brute(rows, n, ratio, seed=2023, disjoint=False):
    """rows: (row_id, t1, t2, text)."""
    m, r = int(ratio * n), int((1 - ratio) * n)
    first = {}
    for row in sorted(rows):
        first.setdefault((row[1], row[2], row[3]), row)
    d = list(first.values())
    sizes = {}
    for row in d:
        sizes[(row[1], row[2])] = sizes.get((row[1], row[2]), 0) + 1
    cum, total = {}, 0
    for g in sorted(sizes, key=lambda g: (sizes[g], g)):
        total += sizes[g]
        cum[g] = total
    minor = [(row, "minor") for row in d if cum[(row[1], row[2])] <= m]
    bound = m if disjoint else m - r
    pool = [row for row in d if cum[(row[1], row[2])] > bound]
    rand = sorted(pool, key=lambda row: (h(seed, row[0]), row[0]))[:r]
    return sorted(minor + [(row, "random") for row in rand])


def run(spark, rows, n, ratio, **kw):
    df = spark.createDataFrame(rows, "row_id long, t1 string, t2 string, text string")
    out = sample.minority_select(df, ["t1", "t2"], "text", "row_id", n, ratio, **kw).collect()
    return sorted(((r["row_id"], r["t1"], r["t2"], r["text"]), r["pool"]) for r in out)


ROWS = ([(i, "a", "x", f"t{i % 3}") for i in range(12)]       # duplicates of text within a group
        + [(100 + i, "b", "y", f"u{i}") for i in range(3)]
        + [(200 + i, "c", "x", f"v{i}") for i in range(2)]
        + [(300 + i, "d", "z", f"w{i}") for i in range(30)])


@pytest.mark.parametrize("n,ratio", [(10, 0.5), (20, 0.3), (10, 0.9), (40, 0.2)])
def test_matches_brute(spark, n, ratio):
    assert run(spark, ROWS, n, ratio) == brute(ROWS, n, ratio)


def test_overlap_and_disjoint(spark):
    got = run(spark, ROWS, 20, 0.4)
    ids = [row[0] for row, _ in got]
    assert len(ids) > len(set(ids))               # pools overlap: a row can come twice
    got = run(spark, ROWS, 20, 0.4, disjoint=True)
    assert got == brute(ROWS, 20, 0.4, disjoint=True)
    ids = [row[0] for row, _ in got]
    assert len(ids) == len(set(ids))


def test_no_minor_group(spark):
    rows = [(i, "a", "x", f"t{i}") for i in range(50)]
    assert run(spark, rows, 10, 0.5) == brute(rows, 10, 0.5)


def test_ratio_bounds(spark):
    with pytest.raises(ValueError):
        run(spark, ROWS, 10, 1.0)


def test_partition_invariance(spark):
    df = spark.createDataFrame(ROWS, "row_id long, t1 string, t2 string, text string")
    from textstrata.operators import sample as S
    one = S.minority_select(df.repartition(1), ["t1", "t2"], "text", "row_id", 20, 0.3).collect()
    many = S.minority_select(df.repartition(16), ["t1", "t2"], "text", "row_id", 20, 0.3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


@pytest.mark.parametrize("disjoint", [False, True])
def test_minority_share_above_a_half(spark, disjoint):
    """The random pool's bound is above zero, so groups are shut out of it."""
    assert run(spark, ROWS, 12, 0.7, disjoint=disjoint) == brute(ROWS, 12, 0.7, disjoint=disjoint)


def test_dedup_compares_digests_and_sorts_no_texts(spark):
    rows = [(1, "a", "x" * 5000), (2, None, "x" * 5000), (3, "a", "x" * 5000), (4, None, "x" * 5000),
            (5, "a", ""), (6, "a", None), (7, "a", ""), (8, "a", None), (9, "ax", "x" * 4999)]
    df = spark.createDataFrame(rows, "row_id long, t string, text string")
    from textstrata.operators import sample as S
    out = S.drop_duplicates_first(df, ["t", "text"], "row_id")
    assert sorted(r["row_id"] for r in out.collect()) == [1, 2, 5, 6, 9]
    assert out.columns == df.columns
    assert S.drop_duplicates_first(df.where("false"), ["t", "text"], "row_id").collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
