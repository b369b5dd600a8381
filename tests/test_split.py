"""S1, S2, S3, S6, S8 against brute force; skew and partition invariance."""
import hashlib
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textstrata.operators import sample
from textstrata.operators.prefix import running_sum


def h(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def quotas(counts, test_size):
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    base = {c: k * n_train // n for c, k in counts.items()}
    rem = {c: k * n_train % n for c, k in counts.items()}
    short = n_train - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:short]:
        base[c] += 1
    return base


def brute_split(rows, test_size, seed):
    by = {}
    for key, c in rows:
        by.setdefault(c, []).append(key)
    q = quotas({c: len(v) for c, v in by.items()}, test_size)
    out = {}
    for c, keys in by.items():
        for i, k in enumerate(sorted(keys, key=lambda k: (h(seed, k), k))):
            out[k] = "train" if i < q[c] else "test"
    return out


def make(spark, rows):
    return spark.createDataFrame(rows, "key long, c string")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_with_hot_class(spark, digits):
    rnd = random.Random(11)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"c{rnd.randint(0, 6)}") for i in range(5000)]
    rows += [(10_000, "single")]                      # a class with one row
    got = {r["key"]: r["split"] for r in
           sample.stratified_split(make(spark, rows), "key", "c", 0.15, 2023, digits=digits).collect()}
    assert got == brute_split(rows, 0.15, 2023)


def test_split_sizes_and_remainders(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 7 + ["b"] * 5 + ["c"] * 3 + ["d"] * 2)]
    got = sample.stratified_split(make(spark, rows), "key", "c", 0.3).collect()
    assert sum(r["split"] == "test" for r in got) == math.ceil(0.3 * 17)
    assert {r["key"]: r["split"] for r in got} == brute_split(rows, 0.3, 2023)


def test_split_partition_invariance(spark):
    rows = [(i, f"c{i % 5}") for i in range(3000)]
    one = sample.stratified_split(make(spark, rows).repartition(1), "key", "c").collect()
    many = sample.stratified_split(make(spark, rows).repartition(64), "key", "c").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_split_strict_errors(spark):
    rows = [(1, "a"), (2, "a"), (3, "b")]           # b has one row
    with pytest.raises(PySparkException):
        sample.stratified_split(make(spark, rows), "key", "c", strict=True).collect()
    rows = [(i, f"c{i % 4}") for i in range(8)]     # fewer test rows than classes
    with pytest.raises(PySparkException):
        sample.stratified_split(make(spark, rows), "key", "c", 0.1, strict=True).collect()


def test_unstratified(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    got = {r["key"]: r["split"] for r in sample.unstratified_split(df, "key", 0.1).collect()}
    assert sum(v == "test" for v in got.values()) == 100
    assert got == brute_split([(k, 0) for k in range(1000)], 0.1, 2023)


@pytest.mark.parametrize("n", [37, 600, 5000, 0])
def test_exact_sample(spark, n):
    df = spark.range(2000).withColumnRenamed("id", "key")
    got = sorted(r["key"] for r in sample.exact_sample(df, n, "key", 7).collect())
    if n <= 0:
        assert len(got) == 2000
        return
    expect = sorted(sorted(range(2000), key=lambda k: (h(7, k), k))[:min(n, 2000)])
    assert got == expect


def test_seeded_shuffle(spark):
    df = spark.range(3000).withColumnRenamed("id", "key").repartition(7)
    got = {r["key"]: r["position"] for r in sample.seeded_shuffle(df, "key", 5, digits=2).collect()}
    order = sorted(range(3000), key=lambda k: (h(5, k), k))
    assert got == {k: i for i, k in enumerate(order)}


def test_replicate_by_count(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 2500)], "g string, n long")
    out = sample.replicate_by_count(df, "n", chunk=100)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append(r["copy"])
    assert "a" not in got
    assert sorted(got["b"]) == [0] and sorted(got["c"]) == list(range(5))
    assert sorted(got["d"]) == list(range(2500))


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=1, max_size=6), st.sampled_from([0.1, 0.15, 0.25, 0.5]))
def test_split_sizes_match_quotas(spark, sizes, test_size):
    classes = [f"c{j}" for j, n in enumerate(sizes) for _ in range(n)]
    rows = list(enumerate(classes))
    got = sample.stratified_split(make(spark, rows), "key", "c", test_size).groupBy("c", "split").count().collect()
    counts = {f"c{j}": n for j, n in enumerate(sizes)}
    q = quotas(counts, test_size)
    train = {r["c"]: r["count"] for r in got if r["split"] == "train"}
    assert {c: train.get(c, 0) for c in counts} == q
    assert sum(r["count"] for r in got if r["split"] == "test") == math.ceil(test_size * sum(sizes))


def test_split_without_boundary_buckets(spark):
    rows = [(1, "a"), (2, "b"), (3, "c")]          # every quota is 0 or the whole class
    got = {r["key"]: r["split"] for r in sample.stratified_split(make(spark, rows), "key", "c", 0.5).collect()}
    assert got == brute_split(rows, 0.5, 2023) == {1: "train", 2: "test", 3: "test"}


def test_split_by_shuffle_join(spark):
    """Without broadcasts the split gives the same rows."""
    rnd = random.Random(4)
    rows = [(i, f"c{rnd.randint(0, 9)}") for i in range(2000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = sample.mark_first_k(make(spark, rows), ["c"], ["key"], sample.split_quotas(0.2), "t",
                                     seed=2023, digits=2)
        got = {r["key"]: ("train" if r["t"] else "test") for r in marked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_split(rows, 0.2, 2023)


def test_two_hundred_thousand_and_one_strata(spark):
    """As many strata as rows but one: quotas still add up to the exact size."""
    n = 200_002
    df = spark.range(n).select(F.col("id").alias("key"), F.greatest(F.col("id"), F.lit(1)).alias("c"))
    got = {r["split"]: r["count"] for r in sample.stratified_split(df, "key", "c", 0.15).groupBy("split").count().collect()}
    n_test = math.ceil(0.15 * n)
    assert got == {"train": n - n_test, "test": n_test}


def test_repeated_keys_fail(spark):
    """A key repeated at the threshold can't give an exact size."""
    df = spark.range(1000).select((F.col("id") % 50).alias("key"))
    with pytest.raises(PySparkException, match="row keys repeat"):
        sample.unstratified_split(df, "key", 0.15).count()


def test_running_sum_matches_a_window(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r["k"]: r["s"] for r in running_sum(df, [F.desc("v"), F.col("k")], F.col("v"), "s").collect()}
    total = 0
    for k, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += v
        assert got[k] == total
    assert running_sum(df.limit(0), [F.col("k")], F.col("v"), "s").collect() == []


def test_semi_join_of_any_key_count(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.range(0, 100, 3).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in sample.semi_join(df, keys, ["k"]).collect()) == list(range(0, 100, 3))
