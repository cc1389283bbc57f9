"""Partition-independent, reproducible uniform draws.

``u(seed, tag, id) = int(first 8 hex digits of md5("seed:tag:id")) / 2^32``

The value depends only on (seed, tag, id), never on row order or partitioning,
and the same expression runs in DuckDB (see ``sql_uniform``), which is what lets
every sampling operator carry a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, tag, cols) -> Column:
    parts = [F.lit(str(seed)), F.lit(str(tag))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                  for c in cols]
    return F.concat_ws(":", *parts)


def uniform(seed, tag, *cols) -> Column:
    """Uniform [0,1) draw keyed by (seed, tag, cols)."""
    h = F.conv(F.substring(F.md5(_key(seed, tag, cols)), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO_32)


def uniform_seed_col(seed_col: Column, tag, *cols) -> Column:
    """Same draw with a per-row seed (e.g. ``seed + trial``)."""
    parts = [seed_col.cast("string"), F.lit(str(tag))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                           for c in cols]
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO_32)


def sql_uniform(seed, tag, *exprs: str) -> str:
    """DuckDB text of the same draw; ``exprs`` are SQL expressions."""
    key = " || ':' || ".join([f"'{seed}'", f"'{tag}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_uniform_seed(seed_expr: str, tag, *exprs: str) -> str:
    key = " || ':' || ".join([f"CAST({seed_expr} AS VARCHAR)", f"'{tag}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"
