"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Compares row count, column names and the sorted rows (doubles rounded to
``digits``), as the driver's order-insensitive check does.
"""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def rows_of(records, cols, digits):
    return sorted((tuple(_norm(r[c], digits) for c in cols) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, query, sql, sf_dir, digits=9):
    sdf = query(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = rows_of([r.asDict(recursive=True) for r in sdf.collect()], s_cols, digits)
    cur = con.execute(sql)
    d_cols_raw = [d[0] for d in cur.description]
    d_records = [dict(zip(d_cols_raw, r)) for r in cur.fetchall()]
    d_cols = sorted(d_cols_raw)
    d_rows = rows_of(d_records, d_cols, digits)
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns spark={s_cols} duckdb={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duckdb={len(d_rows)}")
    elif s_cols == d_cols and s_rows != d_rows:
        bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {bad}")
    return problems, len(s_rows)
