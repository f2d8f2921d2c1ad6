"""Run a registered query in Spark and its oracle in DuckDB; compare.

The comparison mirrors the driver's gate: same row count, same column
names, and the same multiset of rows once columns are sorted by name.
Doubles are rounded to 6 decimals and timestamps rendered as text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

from runlens.sources.tables import TABLES, table_path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from runlens.plans.registry import ORACLE, QUERIES

    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        return {"name": name, "rows": len(s_rows), "oracle": False}
    con = con or duck(sf_dir)
    res = con.execute(ORACLE[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    si = [s_cols.index(c) for c in sorted(s_cols)]
    di = [d_cols.index(c) for c in sorted(d_cols)]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
    out["match"] = sc == dc
    if not out["match"]:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        out["cols"] = sorted(s_cols)
        out["only_spark"], out["only_oracle"] = only_s, only_d
    return out
