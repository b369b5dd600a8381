"""Idem expansion against a brute-force walk, and chunk invariance."""
import random

import pytest

from textstrata.operators.order import _scan_segments, expand_idem


def brute(rows, ignore_case=False):
    """rows: (site, order, text) -> {(site, order): (text, unresolved)}."""
    out = {}
    by_site = {}
    for site, order, text in rows:
        by_site.setdefault(site, []).append((order, text))
    for site, items in by_site.items():
        items.sort()
        for k, (order, text) in enumerate(items):
            is_idem = text is not None and text.lower().startswith("idem")
            if not is_idem:
                out[(site, order)] = (text, False)
                continue
            base = None
            for j in range(k - 1, -1, -1):
                t = items[j][1]
                if t is not None and not t.lower().startswith("idem"):
                    base = t
                    break
            if base is None:
                out[(site, order)] = (text, True)
                continue
            hay = text.lower() if ignore_case else text
            pos = hay.find("idem")
            rest = text[pos + 4:] if pos >= 0 else ""
            out[(site, order)] = (base + rest, False)
    return out


FIXED = [
    (1, 1, "grijs zand"), (1, 2, "idem maar grijs"), (1, 3, "Idem maar grijs"),
    (1, 4, "IDEM met idem grind"), (1, 5, "idem"), (1, 6, "klei"), (1, 7, "idem, nat"),
    (2, 1, "idem first row"), (2, 2, "veen"), (2, 3, None), (2, 4, "idem x"),
    (3, 10, "leem"), (1, 8, "idem after other site"), (3, 11, "Idem, grijs"),
]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "site int, ord long, text string")
    res = expand_idem(df, ["site"], "ord", "text", **kw).collect()
    return {(r["site"], r["ord"]): (r["text"], r["idem_unresolved"]) for r in res}


@pytest.mark.parametrize("chunk", [1 << 20, 1, 2, 3])
def test_fixed_cases(spark, chunk):
    assert run(spark, FIXED, chunk_width=chunk) == brute(FIXED)


def test_rest_after_lowercase_marker_only(spark):
    got = run(spark, FIXED)
    assert got[(1, 3)] == ("grijs zand", False)          # "Idem maar grijs" keeps no rest
    assert got[(1, 4)] == ("grijs zand grind", False)    # cut after the first lower-case idem
    assert got[(2, 1)] == ("idem first row", True)
    assert got[(2, 4)] == ("veen x", False)              # null text is skipped as a base


def test_ignore_case_option(spark):
    got = run(spark, FIXED, rest_match="ignore_case")
    assert got == brute(FIXED, ignore_case=True)


def test_random_with_hot_site_and_small_chunks(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        site = 0 if rnd.random() < 0.4 else rnd.randint(1, 50)   # site 0 holds ~40 % of rows
        text = rnd.choice(["idem", "idem nat", "Idem, x", "zand", "klei", None, "IDEM idem y"])
        rows.append((site, i, text))
    expected = brute(rows)
    assert run(spark, rows, chunk_width=97) == expected
    assert run(spark, rows) == expected


def test_partition_invariance(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 20), i, rnd.choice(["idem", "zand", "Idem, x", "klei"])) for i in range(800)]
    df = spark.createDataFrame(rows, "site int, ord long, text string")
    one = expand_idem(df.repartition(1), ["site"], "ord", "text", chunk_width=50).collect()
    many = expand_idem(df.repartition(64), ["site"], "ord", "text", chunk_width=50).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_null_site_carries_across_chunks(spark):
    rows = [(None, 1, "zand"), (None, 5, "idem x"), (None, 9, "idem"), (1, 2, "idem")]
    got = run(spark, rows, chunk_width=2)
    assert got[(None, 5)] == ("zand x", False) and got[(None, 9)] == ("zand", False)
    assert got[(1, 2)] == ("idem", True)


def test_one_exchange_and_one_sort_of_the_rows(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(FIXED, "site int, ord long, text string")
    keyed = (df.withColumn("_ts_site", F.struct("site")).withColumn("_ts_chunk", F.lit(0))
             .withColumn("_ts_idem", F.lower("text").startswith("idem")))
    plan = _scan_segments(keyed, F.when(~F.col("_ts_idem"), F.col("text")), "ord")._jdf.queryExecution().sparkPlan().toString()
    full = _scan_segments(keyed, F.when(~F.col("_ts_idem"), F.col("text")), "ord")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert full.count("Exchange") == 1 and full.count("Sort [") == 1


def test_extra_columns_stay_and_an_empty_table_stays_empty(spark):
    rows = [(1, 1, "zand", "a"), (1, 40_000, "idem nat", None), (1, 80_000, "idem", "c")]
    df = spark.createDataFrame(rows, "site int, ord long, text string, note string")
    got = expand_idem(df, ["site"], "ord", "text", out_col="full").orderBy("ord").collect()
    assert [(r["text"], r["note"], r["full"]) for r in got] == [
        ("zand", "a", "zand"), ("idem nat", None, "zand nat"), ("idem", "c", "zand")]
    assert expand_idem(df.where("false"), ["site"], "ord", "text").collect() == []


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

TEXTS = ["idem", "Idem, nat", "IDEM idem x", "zand", "klei", None, "grijs idem", "idem idem"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(TEXTS)), min_size=1, max_size=60),
       st.integers(1, 9))
def test_random_shapes_and_chunks(spark, items, chunk):
    rows = [(site, order * 3 + site, text) for order, (site, text) in enumerate(items)]
    assert run(spark, rows, chunk_width=chunk) == brute(rows)
