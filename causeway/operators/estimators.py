"""Effect estimators over per-unit probability arrays and coded samples.

All estimators are linear in the per-unit arrays, so they are formulated as
grouped sums: one ``posexplode`` + hash aggregate (partial, map-side) per
estimate, never a per-row loop and never a join of the arrays back to units.
Every function takes ``by`` (e.g. ``["trial"]``) so all trials run in one job.

Array layout: flattened row-major; full joint ``[X..., Z, Y]``, hybrid ``[Z, Y]``,
outcome ``[Y]``.  The outcome index is its value (y in 0..Y-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.grid import array_totals


# ------------------------------------------------------------------ full joint

def _cells(df: DataFrame, probs: str, n_z: int, n_y: int, by, size=None) -> DataFrame:
    t = array_totals(df, probs, by, size)
    return t.withColumns({"x": (F.floor(F.col("pos") / (n_z * n_y))).cast("int"),
                          "z": (F.floor(F.col("pos") / n_y) % n_z).cast("int"),
                          "y": (F.col("pos") % n_y).cast("int")})


def full_joint_propensity(df: DataFrame, probs: str, n_z: int = 2, n_y: int = 2, by=(), size=None) -> DataFrame:
    """e_z(x) = mean_j sum_y p_j[x,z,y] / mean_j sum_{z,y} p_j[x,z,y].
    0/0 (cell never predicted) gives NULL, which the ATE treats as skipped."""
    by = list(by)
    c = _cells(df, probs, n_z, n_y, by, size)
    xz = c.groupBy(*by, "x", "z").agg(F.sum("s").alias("s_xz"))
    x = c.groupBy(*by, "x").agg(F.sum("s").alias("s_x"))
    e = xz.join(x, [*by, "x"]).withColumn("e", F.try_divide(F.col("s_xz"), F.col("s_x")))
    return (e.groupBy(*by, "x")
            .agg(F.max(F.when(F.col("z") == 0, F.col("e"))).alias("e0"),
                 F.max(F.when(F.col("z") == 1, F.col("e"))).alias("e1")))


def ipw_full(df: DataFrame, probs: str, n_z: int = 2, n_y: int = 2, by=(), size=None) -> DataFrame:
    """J2 + J3: full-joint IPW ATE and the uncorrected joint difference.

    ATE = (1/n) sum_x sum_y y [S(x,1,y)/e1(x) - S(x,0,y)/e0(x)] over cells whose
    propensity pair has no zero, S = sum over units of the arrays (linearity)."""
    by = list(by)
    c = _cells(df, probs, n_z, n_y, by, size)
    e = full_joint_propensity(df, probs, n_z, n_y, by, size)
    # every unit contributes once to every cell, so n is the per-cell count, taken from the
    # same cell totals in the same aggregate (no second scan of the arrays, no join)
    ok = F.coalesce((F.col("e0") != 0) & (F.col("e1") != 0), F.lit(False))
    term = F.when(F.col("z") == 1, F.col("y") * F.col("s") / F.col("e1")) \
        .otherwise(-F.col("y") * F.col("s") / F.col("e0"))
    raw = F.when(F.col("z") == 1, F.col("y") * F.col("s")).otherwise(-F.col("y") * F.col("s"))
    agg = (c.join(e, [*by, "x"])
           .groupBy(*by)
           .agg(F.sum(F.when(ok, term).otherwise(0.0)).alias("_ipw"), F.sum(raw).alias("_raw"),
                F.max("n").alias("n")))
    return agg.select(*by, "n", (F.col("_ipw") / F.col("n")).alias("ate"),
                      (F.col("_raw") / F.col("n")).alias("uncorrected"))


def joint_reweighted(df: DataFrame, probs: str, n_z: int = 2, n_y: int = 2, by=(), size=None) -> DataFrame:
    """J22 ("cre" view): sum_j p_j[x,z,y]/e_z(x) / sum_j 1/e_z(x) = mean p per cell when
    both propensities are non-zero, else NULL (0/0)."""
    by = list(by)
    c = _cells(df, probs, n_z, n_y, by, size)
    e = full_joint_propensity(df, probs, n_z, n_y, by, size)
    ok = F.coalesce((F.col("e0") != 0) & (F.col("e1") != 0), F.lit(False))
    return (c.join(e, [*by, "x"])
            .select(*by, "pos", F.when(ok, F.col("s") / F.col("n")).alias("joint")))


def joint_observed(df: DataFrame, probs: str, by=(), size=None) -> DataFrame:
    """Mean predicted joint."""
    return array_totals(df, probs, by, size).select(*by, "pos", (F.col("s") / F.col("n")).alias("joint"))


# ------------------------------------------------------------------ hybrid

def _zy(probs, z, y, n_y=2):
    return F.element_at(F.col(probs), F.lit(z * n_y + y + 1))


def hybrid_propensity(df: DataFrame, probs: str, strata, n_y: int = 2, by=()) -> DataFrame:
    """Within each sampled-covariate stratum, e_z(x) = mean_j sum_y p_j[z,y]."""
    by, strata = list(by), list(strata)
    p0 = sum(_zy(probs, 0, y, n_y) for y in range(n_y))
    p1 = sum(_zy(probs, 1, y, n_y) for y in range(n_y))
    return (df.groupBy(*by, *strata)
            .agg(F.count("*").alias("n_x"), F.avg(p0).alias("e0"), F.avg(p1).alias("e1")))


def ipw_hybrid(df: DataFrame, probs: str, strata, n_y: int = 2, by=()) -> DataFrame:
    """J5 + J6 in one grouped pass (Horvitz-Thompson, unnormalised; n counts skipped units).

    Per stratum: A = sum_j sum_y y p_j[1,y], B = sum_j sum_y y p_j[0,y]; with
    e_z = mean p_j[z,.], the stratum contributes A/e1 - B/e0 unless e0 or e1 is 0."""
    by, strata = list(by), list(strata)
    p0 = sum(_zy(probs, 0, y, n_y) for y in range(n_y))
    p1 = sum(_zy(probs, 1, y, n_y) for y in range(n_y))
    a = sum(F.lit(float(y)) * _zy(probs, 1, y, n_y) for y in range(1, n_y))
    b = sum(F.lit(float(y)) * _zy(probs, 0, y, n_y) for y in range(1, n_y))
    per = (df.groupBy(*by, *strata)
           .agg(F.count("*").alias("n_x"), F.sum(p0).alias("P0"), F.sum(p1).alias("P1"),
                F.sum(a).alias("A"), F.sum(b).alias("B")))
    e0 = F.col("P0") / F.col("n_x")
    e1 = F.col("P1") / F.col("n_x")
    ok = (e0 != 0) & (e1 != 0)
    contrib = F.when(ok, F.col("A") / e1 - F.col("B") / e0).otherwise(0.0)
    return (per.groupBy(*by)
            .agg(F.sum("n_x").alias("n"), F.sum(contrib).alias("_ipw"), F.sum(F.col("A") - F.col("B")).alias("_raw"))
            .select(*by, "n", (F.col("_ipw") / F.col("n")).alias("ate"),
                    (F.col("_raw") / F.col("n")).alias("uncorrected")))


def balance(df: DataFrame, probs: str, strata, z: str, covariates=None, n_y: int = 2, by=()) -> DataFrame:
    """Weighted standardised mean difference per covariate.

    Over units whose stratum propensities are both non-zero: a = t x / e1,
    b = (1 - t) x / e0; (mean a - mean b) / sqrt((var_pop a + var_pop b) / 2).
    The propensity table has at most one row per grid cell of the strata."""
    by, strata = list(by), list(strata)
    covariates = list(covariates or strata)
    e = hybrid_propensity(df, probs, strata, n_y, by).drop("n_x")
    j = df.join(e, [*by, *strata]).where((F.col("e0") != 0) & (F.col("e1") != 0))
    stacked = j.select(*by, F.col(z).cast("double").alias("t"), "e0", "e1",
                       F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x"))
                                           for c in covariates])).alias("_c"))
    stacked = stacked.select(*by, "t", "e0", "e1", "_c.covariate", "_c.x")
    a = F.col("t") * F.col("x") / F.col("e1")
    b = (1 - F.col("t")) * F.col("x") / F.col("e0")
    g = stacked.groupBy(*by, "covariate").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"),
                                               F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    return g.select(*by, "covariate",
                    F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(0.5 * (F.col("va") + F.col("vb")))).alias("smd"))


# ------------------------------------------------------------------ outcome imputation

def outcome_table(df: DataFrame, probs: str, strata, z: str, by=()) -> DataFrame:
    """Per stratum and arm, mean p(y=1) and count; overlap strata only."""
    by, strata = list(by), list(strata)
    y1 = F.element_at(F.col(probs), 2)
    g = (df.groupBy(*by, *strata)
         .agg(F.count_if(F.col(z) == 0).alias("n0"), F.count_if(F.col(z) == 1).alias("n1"),
              F.avg(F.when(F.col(z) == 0, y1)).alias("m0"), F.avg(F.when(F.col(z) == 1, y1)).alias("m1")))
    return g.where((F.col("n0") > 0) & (F.col("n1") > 0))


def outcome_imputation(df: DataFrame, probs: str, strata, z: str, weights: str = "arm", by=()) -> DataFrame:
    """J9.  ``arm`` (literal): each arm's column averaged with its own arm counts,
    i.e. pooled arm means over overlap strata.  ``marginal``: stratum sizes n_x."""
    by = list(by)
    t = outcome_table(df, probs, strata, z, by)
    if weights == "arm":
        agg = t.groupBy(*by).agg((F.sum(F.col("n1") * F.col("m1")) / F.sum("n1")).alias("t1"),
                                 (F.sum(F.col("n0") * F.col("m0")) / F.sum("n0")).alias("c1"))
        return agg.select(*by, (F.col("t1") - F.col("c1")).alias("ate"))
    w = F.col("n0") + F.col("n1")
    return t.groupBy(*by).agg((F.sum(w * (F.col("m1") - F.col("m0"))) / F.sum(w)).alias("ate"))


# ------------------------------------------------------------------ observed-outcome estimators

def naive(df: DataFrame, z: str, y: str, by=()) -> DataFrame:
    """Difference in means."""
    by = list(by)
    return df.groupBy(*by).agg((F.avg(F.when(F.col(z) == 1, F.col(y))) -
                                F.avg(F.when(F.col(z) == 0, F.col(y)))).alias("ate"))


def ipw_strata(df: DataFrame, strata, z: str, y: str, by=()) -> DataFrame:
    """E6 propensity by counts + J5-form IPW on observed outcomes, with J10 beside it.

    Per stratum: e_z = n_z / n_x; the stratum adds sum(t y)/e1 - sum((1-t) y)/e0
    unless a propensity is 0; divided by all n (skipped units still count)."""
    by, strata = list(by), list(strata)
    per = (df.groupBy(*by, *strata)
           .agg(F.count_if(F.col(z) == 0).alias("n0"), F.count_if(F.col(z) == 1).alias("n1"),
                F.sum(F.when(F.col(z) == 1, F.col(y)).otherwise(0)).alias("y1"),
                F.sum(F.when(F.col(z) == 0, F.col(y)).otherwise(0)).alias("y0")))
    nx = F.col("n0") + F.col("n1")
    ok = (F.col("n0") > 0) & (F.col("n1") > 0)
    contrib = F.when(ok, F.col("y1") / (F.col("n1") / nx) - F.col("y0") / (F.col("n0") / nx)).otherwise(0.0)
    return (per.groupBy(*by)
            .agg(F.sum(nx).alias("n"), F.sum(contrib).alias("_ipw"),
                 F.sum("y1").alias("_y1"), F.sum("n1").alias("_n1"), F.sum("y0").alias("_y0"),
                 F.sum("n0").alias("_n0"))
            .select(*by, "n", (F.col("_ipw") / F.col("n")).alias("ate_ipw"),
                    (F.col("_y1") / F.col("_n1") - F.col("_y0") / F.col("_n0")).alias("ate_naive")))
