"""The order keys agree with DuckDB (so oracles can reproduce every seeded choice)."""
import duckdb

from textstrata.functions.hashing import hash_bucket, hash_order, hash_uniform


def test_md5_order_and_uniform_match_duckdb(spark):
    df = spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    got = {r["k"]: (r["h"], r["b"], r["u"]) for r in df.select(
        "k", hash_order(2023, "k").alias("h"), hash_bucket(hash_order(2023, "k"), 4).alias("b"),
        hash_uniform(2023, "k").alias("u")).collect()}
    con = duckdb.connect()
    rows = con.execute("""
        SELECT k, md5('2023:' || CAST(k AS VARCHAR)) AS h, substr(md5('2023:' || CAST(k AS VARCHAR)), 1, 4) AS b,
               CAST(('0x' || substr(md5('2023:' || CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u
        FROM range(0, 2000, 7) t(k)""").fetchall()
    assert {k: (h, b, u) for k, h, b, u in rows} == got
    assert all(0.0 <= v[2] < 1.0 for v in got.values())
