"""Code/label expressions: map lookups (C6/C7/C9), lenient numeric parse (C10),
right-closed binning (C14), threshold binarisation (C13), ladders (C15) and the
Unknown -> NULL rule (B14).  Maps are literal ``create_map`` expressions, so
Catalyst folds them once per plan and no join is needed for small domains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.spec import UNKNOWN_MARKERS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(d: dict, c) -> Column:
    """NULL when the key is missing (the reference raises)."""
    return F.try_element_at(literal_map(d), _col(c))


def encode_options(options: list, c, aliases: dict | None = None) -> Column:
    """Label -> position in the option list; ``aliases`` are further labels of a code."""
    return lookup({**{lab: i for i, lab in enumerate(options)}, **(aliases or {})}, c)


def decode_options(options: list, c) -> Column:
    """Code -> label."""
    return lookup({i: lab for i, lab in enumerate(options)}, _col(c).cast("int"))


def unknown_to_null(c) -> Column:
    """B14"""
    x = _col(c)
    return F.when(x.isin(*UNKNOWN_MARKERS), F.lit(None)).otherwise(x)


def to_number(c) -> Column:
    """Non-numeric -> NULL (ANSI-safe)."""
    return F.trim(_col(c).cast("string")).try_cast("double")


def fold_or_number(mapping: dict, c) -> Column:
    """Replace known labels by their code, else parse the value as a number."""
    return F.coalesce(lookup(mapping, c).cast("double"), to_number(c))


def binarise(c, t) -> Column:
    """X <= t -> 0, x > t -> 1, NULL stays NULL."""
    x = _col(c)
    return F.when(x <= t, 0).when(x > t, 1).cast("int")


def right_closed_bin(c, edges) -> Column:
    """C14: (e0,e1] -> 0, (e1,e2] -> 1, ...; outside -> NULL (pandas ``cut``)."""
    x = _col(c)
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > edges[i]) & (x <= edges[i + 1])
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.cast("int")


def ladder(c, edges) -> Column:
    """<= e0 -> 0, (e0,e1] -> 1, ..., > e_last -> len(edges)."""
    x = _col(c)
    expr = F.when(x <= edges[0], 0)
    for i in range(1, len(edges)):
        expr = expr.when(x <= edges[i], i)
    return expr.when(x > edges[-1], len(edges)).cast("int")


def recode_with_default(mapping: dict, default: int, c) -> Column:
    """Categorical recode with a catch-all code."""
    return F.coalesce(lookup(mapping, c), F.lit(default)).cast("int")
