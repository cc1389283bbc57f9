"""Side-by-side check of a Spark query and its DuckDB oracle (same rule as the driver:
column names sorted, rows order-insensitive, values compared after rounding)."""

from __future__ import annotations

import math
import os

import duckdb

from causeway.plans.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return ("", )
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", float(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", str(v))


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    rows = spark_df.collect()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in di) for r in d_rows)
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0]}"
    return True, f"{len(a)} rows"
