"""Per-row probability-array expressions.

A probability array is ``ARRAY<DOUBLE>`` flattened row-major; its shape lives in
the spec.  Everything here is a higher-order SQL function, so arrays never leave
the JVM and no UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row.  An expression that a lambda takes
    from outside is computed anew for every element; a lambda's own variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_array_text(c) -> Column:
    """A10: printed NumPy array text "[0.1 0.2\\n 0.7]" -> ARRAY<DOUBLE>."""
    body = F.regexp_replace(_col(c), "^[\\[\\s]+|[\\]\\s]+$", "")
    parts = F.split(body, "\\s+")
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: s.try_cast("double"))


def softmax(c) -> Column:
    """Numerically stable softmax of a log-likelihood array, linear in its length."""
    def scaled(e):
        return let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda s: F.transform(e, lambda v: v / s))

    def shifted(x):
        return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), scaled))

    return let(_col(c).cast("array<double>"), shifted)


def argmax(c) -> Column:
    """0-based index of the first maximum (NumPy tie rule)."""
    x = _col(c)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def draw_index(c, u: Column) -> Column:
    """I4: categorical draw -- first index whose cumulative probability exceeds u (the last
    one if rounding leaves none).  One running-sum fold: linear in the array."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))

    def fold(b):
        found = F.aggregate(b["x"], start, lambda acc, v: F.struct(
            (acc["sum"] + v).alias("sum"), (acc["at"] + 1).alias("at"),
            F.coalesce(acc["hit"], F.when(acc["sum"] + v > b["u"], acc["at"])).alias("hit")))["hit"]
        return F.coalesce(found, F.size(b["x"]) - 1).cast("int")
    return let(F.struct(_col(c).alias("x"), u.alias("u")), fold)


def by_falling(c) -> Column:
    """The array's values with their 0-based index, descending, ties by index."""
    tagged = F.transform(_col(c).cast("array<double>"), lambda v, i: F.struct((-v).alias("key"), i.alias("idx"), v.alias("p")))
    return F.array_sort(tagged)


def nucleus(c, top_p: float) -> Column:
    """the most likely entries (idx, p) in falling order, p renormalised; an entry is
    dropped once the entries before it hold more than ``top_p``.

    Those sums only grow, so the kept entries are a prefix: one fold gives its length and
    mass.  Row-local: no rows are made and nothing is shuffled."""
    def cut(order):
        start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"), F.lit(0.0).alias("mass"))
        kept = F.aggregate(order, start, lambda acc, e: F.struct(
            (acc["before"] + e["p"]).alias("before"), (acc["n"] + (acc["before"] <= top_p).cast("int")).alias("n"),
            (acc["mass"] + F.when(acc["before"] <= top_p, e["p"]).otherwise(0.0)).alias("mass")))
        return let(kept, lambda k: F.transform(F.slice(order, 1, k["n"]), lambda e: F.struct(
            e["idx"].alias("idx"), (e["p"] / k["mass"]).alias("p"))))

    return let(by_falling(c), cut)


def nucleus_draw(kept, u: Column) -> Column:
    """The index of the first nucleus entry whose cumulative mass exceeds u."""
    return let(_col(kept), lambda k: F.element_at(k, draw_index(F.transform(k, lambda e: e["p"]), u) + 1)["idx"])


def array_sum(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda a, b: a + b)


def slice_sum(c, start0: Column | int, length: Column | int) -> Column:
    """Sum of a 0-based slice of log-probabilities."""
    s = start0 if isinstance(start0, Column) else F.lit(start0)
    n = length if isinstance(length, Column) else F.lit(length)
    return F.aggregate(F.slice(_col(c), s + 1, n), F.lit(0.0), lambda a, b: a + b)


def marginal(c, shape, keep_axes) -> Column:
    """Sum a flattened row-major array over every axis not in ``keep_axes``.
    Result is flattened row-major over the kept axes.

    The places that add to an output cell are its own start plus offsets that are the same
    for all cells, so every input value is read once."""
    shape = list(shape)
    strides = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        strides[i] = strides[i + 1] * shape[i + 1]
    offsets, starts = [0], [0]
    for a, (n, step) in enumerate(zip(shape, strides)):
        if a in keep_axes:
            starts = [s + k * step for s in starts for k in range(n)]
        else:
            offsets = [o + k * step for o in offsets for k in range(n)]

    def add(x):
        return F.transform(F.array(*[F.lit(s + 1) for s in starts]), lambda s: F.aggregate(
            F.array(*[F.lit(o) for o in offsets]), F.lit(0.0), lambda total, o: total + F.element_at(x, s + o)))
    return let(_col(c), add)


def kl(a, b, eps: float = 1e-6) -> Column:
    """K1 on two equal-length arrays: sum a*ln(a/(b+eps)) over a != 0."""
    z = F.arrays_zip(_col(a).alias("a"), _col(b).alias("b"))
    return F.aggregate(z, F.lit(0.0), lambda acc, t: acc + F.when(t["a"] != 0, t["a"] * F.log(t["a"] / (t["b"] + eps)))
                       .otherwise(0.0))


def mse(a, b) -> Column:
    """K2 on two equal-length arrays."""
    z = F.arrays_zip(_col(a).alias("a"), _col(b).alias("b"))
    return F.aggregate(z, F.lit(0.0), lambda acc, t: acc + (t["a"] - t["b"]) * (t["a"] - t["b"])) / F.size(_col(a))


def trim_completion(tokens, n_prompt, max_gen: int, stop_tokens, echo: bool = False) -> Column:
    """M7 index range: returns struct(start, stop) 1-based-inclusive-exclusive for
    slicing tokens and log-probs together: drop the prompt unless ``echo``, cap at
    prompt + max_gen, cut at the first stop token."""
    t = _col(tokens)
    np_ = _col(n_prompt) if not isinstance(n_prompt, int) else F.lit(n_prompt)
    start = F.lit(0) if echo else np_
    end = F.least(np_ + F.lit(max_gen), F.size(t))
    window = F.slice(t, start + 1, F.greatest(end - start, F.lit(0)))
    pos = F.transform(F.array(*[F.lit(s) for s in stop_tokens]), lambda s: F.array_position(window, s))
    first = F.array_min(F.filter(pos, lambda p: p > 0))
    length = F.when(first.isNull(), F.size(window)).otherwise(first - 1)
    return F.struct(start.alias("start"), length.alias("length"))
