"""Model-based estimator queries (J11-J21) on the 7.1 unit table and the coded samples.

With a saturated design (a dummy for every cell but one) and no penalty, the fitted
propensity is the cell share and every linear model has a closed form by cell, which is what
the DuckDB oracles compute, from the fit table's cells for the evaluated table."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import models
from causeway.plans import tables as TB
from causeway.plans.registry import cte, register

UNITS_X_SQL = f"""
SELECT unit_id, t, y, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS x FROM ({TB.UNITS_SQL})
"""


def _units_x(spark, sf):
    from causeway.plans.queries import units
    return units(spark, sf).select("unit_id", "t", "y", (F.col("segment") == "BUILDING").cast("int").alias("x"))


def _r4(c):
    return F.round(c, 4)


IPW_LOGIT_SQL = f"""
WITH {cte('u', UNITS_X_SQL)},
e AS (SELECT x, avg(t) AS e FROM u GROUP BY x),
j AS (SELECT u.*, e.e FROM u JOIN e USING (x))
SELECT 'ipw' AS estimator,
       round(sum(t * y / e) / sum(t / e) - sum((1 - t) * y / (1 - e)) / sum((1 - t) / (1 - e)), 4) AS ate FROM j
"""


@register("ipw_logistic_orders", IPW_LOGIT_SQL)
def ipw_logistic_orders(spark, sf):
    """Logistic propensity (unpenalised, saturated) -> weighted arm means."""
    r = models.estimate(_units_x(spark, sf), ["x"], "t", "y", "ipw", penalty=0.0)
    return r.select("estimator", _r4("ate").alias("ate"))


_OLS = """
c AS (SELECT covar_pop(t, y) AS sty, covar_pop(x, y) AS sxy, var_pop(t) AS stt, var_pop(x) AS sxx,
             covar_pop(t, x) AS stx FROM u)"""

STD_SQL = f"""
WITH {cte('u', UNITS_X_SQL)}, {_OLS.strip()}
SELECT 'standardization' AS estimator, round((sty * sxx - stx * sxy) / (stt * sxx - stx * stx), 6) AS ate FROM c
"""


@register("standardization_orders", STD_SQL)
def standardization_orders(spark, sf):
    """Linear outcome model with treatment as a feature; ATE = its coefficient."""
    r = models.estimate(_units_x(spark, sf), ["x"], "t", "y", "standardization", penalty=0.0)
    return r.select("estimator", F.round("ate", 6).alias("ate"))


STRAT_SQL = f"""
WITH {cte('u', UNITS_X_SQL)},
m AS (SELECT x, avg(y) FILTER (WHERE t = 1) AS m1, avg(y) FILTER (WHERE t = 0) AS m0, count(*) AS n FROM u GROUP BY x)
SELECT 'strat_std' AS estimator, round(sum(n * (m1 - m0)) / sum(n), 6) AS ate FROM m
"""


@register("strat_standardization_orders", STRAT_SQL)
def strat_standardization_orders(spark, sf):
    """A linear model per arm (saturated in x), both applied to every unit."""
    r = models.estimate(_units_x(spark, sf), ["x"], "t", "y", "strat_std", penalty=0.0)
    return r.select("estimator", F.round("ate", 6).alias("ate"))


AIPW_SQL = f"""
WITH {cte('u', UNITS_X_SQL)}, {_OLS.strip()},
b AS (SELECT (sty * sxx - stx * sxy) / (stt * sxx - stx * stx) AS bt,
             (sxy * stt - stx * sty) / (stt * sxx - stx * stx) AS bx FROM c),
a AS (SELECT avg(y) - (SELECT bt FROM b) * avg(t) - (SELECT bx FROM b) * avg(x) AS a0 FROM u),
e AS (SELECT x, avg(t) AS e FROM u GROUP BY x),
j AS (SELECT u.*, e.e, a.a0 + b.bt + b.bx * u.x AS m1, a.a0 + b.bx * u.x AS m0
      FROM u JOIN e USING (x) CROSS JOIN a CROSS JOIN b)
SELECT 'dr_vanilla' AS estimator,
       round(avg(m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e)), 4) AS ate FROM j
"""


@register("aipw_orders", AIPW_SQL)
def aipw_orders(spark, sf):
    """Doubly robust AIPW (linear outcome model + logistic propensity)."""
    r = models.estimate(_units_x(spark, sf), ["x"], "t", "y", "dr_vanilla", penalty=0.0)
    return r.select("estimator", _r4("ate").alias("ate"))


@register("estimator_comparison_orders")
def estimator_comparison_orders(spark, sf):
    """J17 (+ J15, J16, J10): every registry estimator on one unit table, default
    C=1 penalty; market segment and region as covariates.  No SQL oracle: the
    penalised logistic fit is iterative (tests compare it with MLlib and numpy)."""
    from causeway.plans.queries import units
    u = units(spark, sf)
    u = u.withColumns({f"seg_{s.lower()}": (F.col("segment") == s).cast("int") for s in SEGMENTS[1:]})
    u = u.withColumns({f"region_{r}": (F.col("region") == r).cast("int") for r in range(1, 5)})
    xs = [f"seg_{s.lower()}" for s in SEGMENTS[1:]] + [f"region_{r}" for r in range(1, 5)]
    return models.compare(u, xs, "t", "y").select("estimator", F.round("ate", 4).alias("ate"))


# ------------------------------------------------------------------ saturated designs with oracles

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def saturated_sql(units_sql: str, fit_on: dict, keep=models.ESTIMATORS) -> str:
    """(tbl, estimator, ate) from ``units_sql`` (tbl, cell, t, y), by closed forms.

    In a cell of the fit table let e be the share treated, d the difference of arm means, n the
    units, v = n e (1 - e) and g = 1/e - 1/(1 - e).  The treatment coefficient is the v-mean of
    d; with weights 1/e and 1/(1 - e) it is the n-mean; with the weight as a feature it solves
    the two equations of (1, g), since a weight is linear in the treatment inside a cell."""
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in fit_on.items())
    values = {
        "naive": "sum(n1 * y1 - 0) / sum(n1) - sum(n0 * y0) / sum(n0)",
        "ipw": "sum(n1 * y1 / e) / sum(n1 / e) - sum(n0 * y0 / (1 - e)) / sum(n0 / (1 - e))",
        "standardization": "max(b)", "strat_std": "sum(n * d) / sum(n)",
        "dr_vanilla": "sum(n * b + n1 * (y1 - m0 - b) / e - n0 * (y0 - m0) / (1 - e)) / sum(n)",
        "dr_ipfeature": "sum(n * (bt + bw * g)) / sum(n)", "dr_importance": "max(bi)"}
    selects = " UNION ALL ".join(f"SELECT tbl, '{k}' AS estimator, {values[k]} AS ate FROM ev GROUP BY tbl" for k in keep)
    return f"""
WITH {cte('su', units_sql)},
sc AS (SELECT tbl, cell, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0,
              avg(y) FILTER (WHERE t = 1) AS y1, avg(y) FILTER (WHERE t = 0) AS y0 FROM su GROUP BY tbl, cell),
sp(tbl, src) AS (VALUES {pairs}),
sf AS (SELECT sp.tbl, sc.cell, n1 + n0 AS n, n1 / (n1 + n0) AS e, y1 - y0 AS d, (n1 * y1 + n0 * y0) / (n1 + n0) AS yb
       FROM sp JOIN sc ON sc.tbl = sp.src),
sv AS (SELECT *, n * e * (1 - e) AS v, 1 / e - 1 / (1 - e) AS g FROM sf),
sb AS (SELECT tbl, sum(v * d) / sum(v) AS b, sum(n * d) / sum(n) AS bi, sum(v) AS v0, sum(v * g) AS v1, sum(v * g * g) AS v2,
              sum(v * d) AS r0, sum(v * d * g) AS r1 FROM sv GROUP BY tbl),
ev AS (SELECT sc.tbl, sc.n1, sc.n0, sc.n1 + sc.n0 AS n, sc.y1, sc.y0, sv.e, sv.d, sv.g, sb.b, sb.bi, sv.yb - sb.b * sv.e AS m0,
              (r0 * v2 - r1 * v1) / (v0 * v2 - v1 * v1) AS bt, (v0 * r1 - v1 * r0) / (v0 * v2 - v1 * v1) AS bw
       FROM sp JOIN sc ON sc.tbl = sp.tbl JOIN sv ON sv.tbl = sp.tbl AND sv.cell = sc.cell JOIN sb ON sb.tbl = sp.tbl)
SELECT tbl AS "table", estimator, round(ate, 6) AS ate FROM ({selects})
"""


def dummies(df, cell, cells):
    """``df`` with a 0/1 column for every cell but the first, and their names."""
    names = [f"is_{i}" for i in range(1, len(cells))]
    return df.withColumns({n: (cell == F.lit(c)).cast("int") for n, c in zip(names, cells[1:])}), names


COMPARISON_SQL = saturated_sql(f"SELECT 'units' AS tbl, segment || region AS cell, t, y FROM ({TB.UNITS_SQL})", {"units": "units"})


@register("estimator_comparison_cells_orders", COMPARISON_SQL)
def estimator_comparison_cells_orders(spark, sf):
    """All seven estimators adjusting for every cell of segment and region."""
    from causeway.plans.queries import units
    u, xs = dummies(units(spark, sf), F.concat("segment", F.col("region").cast("string")), [f"{s}{r}" for s in SEGMENTS for r in range(5)])
    r = models.compare(u, xs, "t", "y", penalty=0.0)
    return r.select(F.lit("units").alias("table"), "estimator", F.round("ate", 6).alias("ate"))


def _benchmark_sql():
    from causeway.plans.q_effects import RESAMPLE_SQL, SPLIT_SQL
    cell = "CASE WHEN segment = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN region = 1 THEN 1 ELSE 0 END AS cell"
    return saturated_sql(f"""
SELECT s.split AS tbl, {cell}, t, y FROM ({TB.UNITS_SQL}) u JOIN ({SPLIT_SQL}) s USING (unit_id)
UNION ALL SELECT 'observational', {cell}, t, y FROM ({TB.UNITS_SQL}) u JOIN ({RESAMPLE_SQL}) r USING (unit_id)
""", BENCHMARK_FITS)


#: Models of the trial are fitted on its train part; the confounded table has its own.
BENCHMARK_FITS = {"train": "train", "val": "train", "observational": "observational"}


@register("benchmark_orders", _benchmark_sql())
def benchmark_orders(spark, sf):
    """J18 + J19: all seven estimators on the trial split (I2) -- fitted on train, evaluated on
    train and val -- and on the confounded observational resample (I1)."""
    from causeway.operators import sampling
    from causeway.plans.q_effects import RESAMPLE_P, RESAMPLE_SEED, SPLIT_SEED, SPLIT_TRAIN, SPLIT_VAL
    from causeway.plans.queries import units
    u = units(spark, sf).select("unit_id", "t", "y", (F.col("segment") == "BUILDING").cast("int").alias("x"),
                                (F.col("region") == 1).cast("int").alias("r1")).withColumn("xr", F.col("x") * F.col("r1"))
    split = sampling.stratified_split(u, ["t", "y"], SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED)
    obs = sampling.confounded_resample(u, "x", "t", RESAMPLE_P, RESAMPLE_SEED).withColumn("split", F.lit("observational"))
    both = split.unionByName(obs.drop("draw_id")).withColumnRenamed("split", "table")
    r = models.benchmark(both, "table", BENCHMARK_FITS, ["x", "r1", "xr"], "t", "y", penalty=0.0)
    return r.select("table", "estimator", F.round("ate", 6).alias("ate"))


def _trial_benchmark_sql():
    from causeway.functions.draws import sql_uniform_seed
    from causeway.plans.q_effects import N_TRIALS, TRIAL_SEED, TRIAL_SIZE
    u = sql_uniform_seed(f"{TRIAL_SEED} + tr.trial", "trial", "u.unit_id")
    return saturated_sql(f"""
SELECT 'trial ' || trial AS tbl, CASE WHEN segment = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN region = 1 THEN 1 ELSE 0 END AS cell, t, y
FROM (SELECT u.*, tr.trial, row_number() OVER (PARTITION BY tr.trial ORDER BY {u}, u.unit_id) AS rn
      FROM ({TB.UNITS_SQL}) u CROSS JOIN range({N_TRIALS}) AS tr(trial)) WHERE rn <= {TRIAL_SIZE}
""", {f"trial {k}": f"trial {k}" for k in range(N_TRIALS)})


@register("trial_benchmark_orders", _trial_benchmark_sql())
def trial_benchmark_orders(spark, sf):
    """K7 + J18: all seven estimators on each of three trials, from one scan."""
    from causeway.operators import sampling
    from causeway.plans.q_effects import N_TRIALS, TRIAL_SEED, TRIAL_SIZE
    from causeway.plans.queries import units
    tr = sampling.trials(units(spark, sf), N_TRIALS, TRIAL_SIZE, TRIAL_SEED)
    tr = tr.select("t", "y", (F.col("segment") == "BUILDING").cast("int").alias("x"), (F.col("region") == 1).cast("int").alias("r1"),
                   F.concat(F.lit("trial "), F.col("trial").cast("string")).alias("table")).withColumn("xr", F.col("x") * F.col("r1"))
    names = [f"trial {k}" for k in range(N_TRIALS)]
    r = models.benchmark(tr, "table", dict(zip(names, names)), ["x", "r1", "xr"], "t", "y", penalty=0.0)
    return r.select("table", "estimator", F.round("ate", 6).alias("ate"))


# ------------------------------------------------------------------ J20 / J21 on the coded samples

SUBSET_SEED = 17


def _sample_sql():
    from causeway.functions.draws import sql_uniform
    from causeway.plans.queries import _email_sql
    coded = f"SELECT mens * 2 + womens AS cell, email_type AS t, visit AS y, unit_id FROM ({_email_sql()})"
    return saturated_sql(f"""
SELECT 'all' AS tbl, cell, t, y FROM ({coded})
UNION ALL SELECT 'subset', cell, t, y FROM ({coded}) WHERE {sql_uniform(SUBSET_SEED, 'subset', 'unit_id')} < 0.5
""", {"subset": "subset", "all": "subset"})


def _samples(spark, sf):
    """Coded samples twice: all of them, and the keyed half on which models are fitted."""
    from causeway.functions.draws import uniform
    from causeway.plans.q_misc import _email_codes
    s = _email_codes(spark, sf).withColumns({c: F.col(c).cast("int") for c in
                                             ("recency", "history", "mens", "womens", "zip_code", "newbie",
                                              "channel", "email_type", "visit")})
    tables = F.when(uniform(SUBSET_SEED, "subset", "unit_id") < 0.5, F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))
    return s.withColumn("table", F.explode(tables))


@register("sample_estimators_orders")
def sample_estimators_orders(spark, sf):
    """J20 + J21: all seven estimators on the coded email-marketing samples (strata codes as
    covariates, email_type -> visit), fitted on a subset, evaluated on it and on all.  No SQL
    oracle: penalised multi-covariate fits."""
    xs = ["recency", "history", "mens", "womens", "zip_code", "newbie", "channel"]
    r = models.benchmark(_samples(spark, sf), "table", {"subset": "subset", "all": "subset"}, xs, "email_type", "visit")
    return r.select("table", "estimator", F.round("ate", 6).alias("ate"))


@register("sample_estimators_cells_orders", _sample_sql())
def sample_estimators_cells_orders(spark, sf):
    """J20 + J21 with the four cells of two strata as the design, against closed forms."""
    s = _samples(spark, sf).withColumn("both", F.col("mens") * F.col("womens"))
    r = models.benchmark(s, "table", {"subset": "subset", "all": "subset"}, ["mens", "womens", "both"], "email_type", "visit", penalty=0.0)
    return r.select("table", "estimator", F.round("ate", 6).alias("ate"))
