import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label_id", "label", "n", "weight"]
    assert len(rows) == 2
    # balanced weights: sum n_c * w_c == n
    n = sum(r["n"] for r in rows)
    assert abs(sum(r["n"] * r["weight"] for r in rows) - n) < 1e-9


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
