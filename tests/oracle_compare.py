"""Compare a Spark query with its DuckDB oracle: rows, columns, values.

Columns are compared by name (sorted), rows order-insensitively.  Values
must be equal; doubles are compared exactly unless ``rel_tol`` is given.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__) if v is not None else "", v if v is not None else 0)
                 for v in row)


def compare(spark_df, con, sql: str, rel_tol: float = 0.0) -> tuple[bool, str]:
    srows = spark_df.collect()
    scols = spark_df.columns
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={scols} duck={dcols}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=_key)
    if len(s) != len(d):
        return False, f"row count spark={len(s)} duck={len(d)}"
    for a, b in zip(s, d):
        for col, x, y in zip(order, a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, (float, int)) and rel_tol and \
                    math.isclose(x, y, rel_tol=rel_tol):
                continue
            return False, f"value differs in {col}: spark={a} duck={b}"
    return True, f"{len(s)} rows"
