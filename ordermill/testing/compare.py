"""Compare a Spark result with a DuckDB oracle the way the correctness gate does:
row count, column names, and an order-insensitive comparison of the values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return "None" if v is None else str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    body = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, body


def compare(spark, query_fn, sql: str, sf_dir: str, con=None) -> dict:
    df = query_fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duckdb_connection(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sb = normalise(s_cols, s_rows)
    dc, db = normalise(d_cols, d_rows)
    out = {"rows": (len(sb), len(db)), "columns_match": sc == dc, "values_match": sb == db}
    if sc != dc:
        out["columns"] = (sc, dc)
    elif sb != db:
        diff = [(a, b) for a, b in zip(sb, db) if a != b][:3]
        out["first_diffs"] = diff
    out["ok"] = out["columns_match"] and out["values_match"]
    return out
