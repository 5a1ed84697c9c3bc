"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's check: same column names,
same row count, order-insensitive equal values)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def _key(t):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)


def compare(df, con, sql):
    """Return (ok, message)."""
    sc, sr = rows_of_spark(df)
    dc, dr = rows_of_duck(con, sql)
    if [c.lower() for c in sc] != [c.lower() for c in dc]:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    ss = sorted(sr, key=_key)
    ds = sorted(dr, key=_key)
    bad = [(a, b) for a, b in zip(ss, ds) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[:3]}"
    return True, f"{len(sr)} rows equal"
