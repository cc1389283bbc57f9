"""Queries for probability arrays, estimators, sampling and evaluation.

Bindings (SURVEY 7.3): the 64 embedding values are option log-likelihoods of shape
(16, 2, 2); the (2, 2) and (2) arrays are marginals of that joint (C26); sampled
covariates are signs of embedding values; ``documents x labels`` gives (lang, quality, toxic);
the 7.1 unit table (orders x customer x nation) feeds the sampling operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions.draws import sql_uniform, sql_uniform_seed
from causeway.operators import distributions, estimators, evaluate, grid, sampling
from causeway.plans import tables as TB
from causeway.plans.registry import cte, r6, register
from causeway.spec import StudySpec

# ------------------------------------------------------------------ embedding unit table


#: Shape of the joint (X, treatment, outcome) that an embedding's values spell.
SHAPE = (16, 2, 2)
CELLS = 64


def emb_units(spark, sf):
    e = TB.table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    e = e.select("*", A.softmax(v).alias("p_full"))
    return e.select(
        F.col("vec_id").alias("unit_id"), "p_full",
        A.marginal("p_full", SHAPE, (1, 2)).alias("p_zy"),
        A.marginal("p_full", SHAPE, (2,)).alias("p_y"),
        (F.element_at(v, 9) > 0).cast("int").alias("sample_z"),
        (F.element_at(v, 10) > 0).cast("int").alias("sample_a"),
        (F.element_at(v, 11) > 0).cast("int").alias("sample_b"))


def _softmax_sql(k, name):
    return f"""
{name}_ex AS (SELECT vec_id AS unit_id, r.pos - 1 AS pos, CAST(embedding[r.pos] AS DOUBLE) AS l
              FROM embeddings CROSS JOIN range(1, {k + 1}) AS r(pos)),
{name}_mx AS (SELECT unit_id, max(l) AS m FROM {name}_ex GROUP BY unit_id),
{name}_ee AS (SELECT x.unit_id, x.pos, exp(x.l - m.m) AS e FROM {name}_ex x JOIN {name}_mx m USING (unit_id)),
{name} AS (SELECT unit_id, pos, e / sum(e) OVER (PARTITION BY unit_id) AS p FROM {name}_ee)"""


_SAMPLES_SQL = """
smp AS (SELECT vec_id AS unit_id, CAST(embedding[9] > 0 AS INTEGER) AS sample_z,
               CAST(embedding[10] > 0 AS INTEGER) AS sample_a, CAST(embedding[11] > 0 AS INTEGER) AS sample_b
        FROM embeddings)"""

IPW_FULL_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')},
cells AS (SELECT pos, sum(p) AS s, pos // 4 AS x, (pos // 2) % 2 AS z, pos % 2 AS y FROM pf GROUP BY pos),
sxz AS (SELECT x, z, sum(s) AS s_xz FROM cells GROUP BY x, z),
sx AS (SELECT x, sum(s) AS s_x FROM cells GROUP BY x),
e AS (SELECT sxz.x, max(CASE WHEN z = 0 AND s_x <> 0 THEN s_xz / s_x END) AS e0,
             max(CASE WHEN z = 1 AND s_x <> 0 THEN s_xz / s_x END) AS e1
      FROM sxz JOIN sx USING (x) GROUP BY sxz.x),
n AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(n.n AS BIGINT) AS n,
       round(sum(CASE WHEN coalesce(e0 <> 0 AND e1 <> 0, false)
                      THEN CASE WHEN z = 1 THEN y * s / e1 ELSE -y * s / e0 END ELSE 0 END) / n.n, 6) AS ate,
       round(sum(CASE WHEN z = 1 THEN y * s ELSE -y * s END) / n.n, 6) AS uncorrected
FROM cells JOIN e USING (x) CROSS JOIN n GROUP BY n.n
"""


@register("ipw_full_embeddings", IPW_FULL_SQL)
def ipw_full_embeddings(spark, sf):
    """C23 + E7 + J1 + J2 + J3: full-joint IPW ATE over softmaxed (16,2,2) arrays."""
    r = estimators.ipw_full(emb_units(spark, sf), "p_full", 2, 2, size=CELLS)
    return r.select(F.col("n").cast("bigint").alias("n"), r6("ate").alias("ate"), r6("uncorrected").alias("uncorrected"))


JOINT_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')},
cells AS (SELECT pos, sum(p) AS s, count(*) AS cnt, pos // 4 AS x, (pos // 2) % 2 AS z FROM pf GROUP BY pos),
sxz AS (SELECT x, z, sum(s) AS s_xz FROM cells GROUP BY x, z),
sx AS (SELECT x, sum(s) AS s_x FROM cells GROUP BY x),
e AS (SELECT sxz.x, max(CASE WHEN z = 0 AND s_x <> 0 THEN s_xz / s_x END) AS e0,
             max(CASE WHEN z = 1 AND s_x <> 0 THEN s_xz / s_x END) AS e1
      FROM sxz JOIN sx USING (x) GROUP BY sxz.x)
SELECT CAST(pos AS INTEGER) AS pos, round(s / cnt, 6) AS joint_obs,
       round(CASE WHEN coalesce(e0 <> 0 AND e1 <> 0, false) THEN s / cnt END, 6) AS joint_cre
FROM cells JOIN e USING (x)
"""


@register("joint_embeddings", JOINT_SQL)
def joint_embeddings(spark, sf):
    """J22 + J23: predicted joint, plain mean and propensity-reweighted view."""
    u = emb_units(spark, sf)
    o = estimators.joint_observed(u, "p_full", size=CELLS).withColumnRenamed("joint", "joint_obs")
    c = estimators.joint_reweighted(u, "p_full", 2, 2, size=CELLS).withColumnRenamed("joint", "joint_cre")
    return o.join(c, "pos").select(F.col("pos").cast("int").alias("pos"), r6("joint_obs").alias("joint_obs"),
                                   r6("joint_cre").alias("joint_cre"))


SOFTMAX_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')},
mx AS (SELECT unit_id, max(p) AS mp FROM pf GROUP BY unit_id),
am AS (SELECT pf.unit_id, min(pos) AS argmax, max(mx.mp) AS posterior FROM pf JOIN mx USING (unit_id)
       WHERE pf.p = mx.mp GROUP BY pf.unit_id),
cum AS (SELECT unit_id, pos, sum(p) OVER (PARTITION BY unit_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM pf),
dr AS (SELECT c.unit_id, coalesce(min(pos) FILTER (WHERE c > {sql_uniform(7, 'draw', 'c.unit_id')}), {CELLS - 1}) AS drawn
       FROM cum c GROUP BY c.unit_id)
SELECT am.unit_id, CAST(argmax AS INTEGER) AS argmax, round(posterior, 6) AS posterior, CAST(drawn AS INTEGER) AS drawn
FROM am JOIN dr USING (unit_id)
"""


@register("softmax_draw_embeddings", SOFTMAX_SQL)
def softmax_draw_embeddings(spark, sf):
    """C23 + C24 + G3 + I4: arg-max option, its posterior and a keyed categorical draw."""
    from causeway.functions.draws import uniform
    u = emb_units(spark, sf)
    return u.select("unit_id", A.argmax("p_full").alias("argmax"), r6(F.array_max("p_full")).alias("posterior"),
                    A.draw_index("p_full", uniform(7, "draw", "unit_id")).alias("drawn"))


TOP_P = 0.8
NUCLEUS_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')},
o AS (SELECT unit_id, pos, p, row_number() OVER (PARTITION BY unit_id ORDER BY p DESC, pos) AS rnk,
             sum(p) OVER (PARTITION BY unit_id ORDER BY p DESC, pos ROWS UNBOUNDED PRECEDING) AS cum FROM pf),
k AS (SELECT unit_id, pos, rnk, p / sum(p) OVER (PARTITION BY unit_id) AS pn FROM o WHERE NOT (cum - p > {TOP_P})),
c AS (SELECT unit_id, pos, rnk, sum(pn) OVER (PARTITION BY unit_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cc FROM k)
SELECT unit_id, CAST(count(*) AS BIGINT) AS n_kept,
       CAST(coalesce(arg_min(pos, rnk) FILTER (WHERE cc > {sql_uniform(5, 'nucleus', 'unit_id')}), arg_max(pos, rnk))
            AS INTEGER) AS drawn
FROM c GROUP BY unit_id
"""


@register("nucleus_embeddings", NUCLEUS_SQL)
def nucleus_embeddings(spark, sf):
    """F4 + G2 + I5: nucleus cut (top_p 0.8) of softmaxed options, then a keyed draw."""
    u = emb_units(spark, sf)
    kept = distributions.nucleus(u, "p_full", TOP_P)
    return distributions.nucleus_draw(kept, "unit_id", seed=5).select(
        "unit_id", F.col("n_kept").cast("bigint").alias("n_kept"), "drawn")


_ZY_SQL = f"""
{_softmax_sql(CELLS, 'pf')},
pz AS (SELECT unit_id, pos % 4 AS pos, sum(p) AS p FROM pf GROUP BY unit_id, pos % 4),
pw AS (SELECT unit_id, max(CASE WHEN pos = 0 THEN p END) AS p00, max(CASE WHEN pos = 1 THEN p END) AS p01,
              max(CASE WHEN pos = 2 THEN p END) AS p10, max(CASE WHEN pos = 3 THEN p END) AS p11
       FROM pz GROUP BY unit_id),
{_SAMPLES_SQL.strip()},
j AS (SELECT * FROM pw JOIN smp USING (unit_id)),
st AS (SELECT sample_a, sample_b, count(*) AS n_x, sum(p00 + p01) AS P0, sum(p10 + p11) AS P1,
              sum(p11) AS A, sum(p01) AS B FROM j GROUP BY sample_a, sample_b)"""

IPW_HYBRID_SQL = f"""
WITH {_ZY_SQL}
SELECT CAST(sum(n_x) AS BIGINT) AS n,
       round(sum(CASE WHEN P0 / n_x <> 0 AND P1 / n_x <> 0 THEN A / (P1 / n_x) - B / (P0 / n_x) ELSE 0 END)
             / sum(n_x), 6) AS ate,
       round(sum(A - B) / sum(n_x), 6) AS uncorrected
FROM st
"""


@register("ipw_hybrid_embeddings", IPW_HYBRID_SQL)
def ipw_hybrid_embeddings(spark, sf):
    """J4 + J5 + J6 + B19: hybrid IPW with sampled-covariate strata."""
    r = estimators.ipw_hybrid(emb_units(spark, sf), "p_zy", ["sample_a", "sample_b"])
    return r.select(F.col("n").cast("bigint").alias("n"), r6("ate").alias("ate"), r6("uncorrected").alias("uncorrected"))


BALANCE_SQL = f"""
WITH {_ZY_SQL},
w AS (SELECT j.sample_z AS t, j.sample_a, j.sample_b, st.P0 / st.n_x AS e0, st.P1 / st.n_x AS e1
      FROM j JOIN st USING (sample_a, sample_b) WHERE st.P0 / st.n_x <> 0 AND st.P1 / st.n_x <> 0),
s AS (SELECT 'sample_a' AS covariate, t, e0, e1, CAST(sample_a AS DOUBLE) AS x FROM w
      UNION ALL SELECT 'sample_b', t, e0, e1, CAST(sample_b AS DOUBLE) FROM w),
g AS (SELECT covariate, avg(t * x / e1) AS ma, avg((1 - t) * x / e0) AS mb,
             var_pop(t * x / e1) AS va, var_pop((1 - t) * x / e0) AS vb FROM s GROUP BY covariate)
SELECT covariate, round(CASE WHEN sqrt(0.5 * (va + vb)) <> 0 THEN (ma - mb) / sqrt(0.5 * (va + vb)) END, 6) AS smd FROM g
"""


@register("balance_embeddings", BALANCE_SQL)
def balance_embeddings(spark, sf):
    """Weighted standardised mean difference of each sampled covariate."""
    r = estimators.balance(emb_units(spark, sf), "p_zy", ["sample_a", "sample_b"], "sample_z")
    return r.select("covariate", r6("smd").alias("smd"))


OI_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')},
py AS (SELECT unit_id, pos % 2 AS pos, sum(p) AS p FROM pf GROUP BY unit_id, pos % 2),
p1 AS (SELECT unit_id, p AS y1 FROM py WHERE pos = 1),
{_SAMPLES_SQL.strip()},
t AS (SELECT sample_a, sample_b, count(*) FILTER (WHERE sample_z = 0) AS n0, count(*) FILTER (WHERE sample_z = 1) AS n1,
             avg(y1) FILTER (WHERE sample_z = 0) AS m0, avg(y1) FILTER (WHERE sample_z = 1) AS m1
      FROM p1 JOIN smp USING (unit_id) GROUP BY sample_a, sample_b HAVING n0 > 0 AND n1 > 0)
SELECT round(sum(n1 * m1) / sum(n1) - sum(n0 * m0) / sum(n0), 6) AS ate_arm,
       round(sum((n0 + n1) * (m1 - m0)) / sum(n0 + n1), 6) AS ate_marginal
FROM t
"""


@register("outcome_imputation_embeddings", OI_SQL)
def outcome_imputation_embeddings(spark, sf):
    """J8 + J9 + B20: outcome imputation over overlap strata, arm and marginal weights."""
    u = emb_units(spark, sf)
    arm, marginal = (estimators.outcome_imputation(u, "p_y", ["sample_a", "sample_b"], "sample_z", weights=w) for w in ("arm", "marginal"))
    # one row each
    return arm.select(r6("ate").alias("ate_arm"), F.lit(1).alias("one")).join(
        marginal.select(r6("ate").alias("ate_marginal"), F.lit(1).alias("one")), "one").drop("one")


MARGINAL_SQL = f"""
WITH {_softmax_sql(CELLS, 'pf')}
SELECT unit_id, CAST(pos // 4 AS INTEGER) AS x, round(sum(p), 6) AS p_x,
       round(sum(p) FILTER (WHERE pos % 2 = 1), 6) AS p_xy1 FROM pf GROUP BY unit_id, pos // 4
"""


@register("marginal_embeddings", MARGINAL_SQL)
def marginal_embeddings(spark, sf):
    """The joint's marginals over X and over (X, outcome = 1), a row per covariate cell."""
    u = emb_units(spark, sf).select("unit_id", A.marginal("p_full", SHAPE, (0,)).alias("px"), A.marginal("p_full", SHAPE, (0, 2)).alias("pxy"))
    return u.select("unit_id", F.posexplode("px").alias("x", "p_x"), "pxy").select(
        "unit_id", F.col("x").cast("int").alias("x"), r6("p_x").alias("p_x"), r6(F.element_at("pxy", 2 * F.col("x") + 2)).alias("p_xy1"))


# ------------------------------------------------------------------ documents x labels

DOC_STUDY = StudySpec(
    name="documents", x=("lang",), y="toxic", z="quality", strata=("lang",), enum=("lang",),
    options={"lang": ["de", "en", "es", "fr"], "quality": ["0", "1"], "toxic": ["0", "1"]})

DOC_UNITS_SQL = """
SELECT d.doc_id AS unit_id, CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS lang,
       l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def doc_units(spark, sf):
    return TB.derived(spark, sf, DOC_UNITS_SQL, ("documents", "labels"))


JOINT_DOCS_SQL = f"""
WITH {cte('u', DOC_UNITS_SQL)},
c AS (SELECT lang * 4 + quality * 2 + toxic AS cell, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT CAST(range AS INTEGER) AS cell FROM range(16))
SELECT g.cell, round(coalesce(c.n, 0) / (SELECT count(*) FROM u), 6) AS freq FROM g LEFT JOIN c USING (cell)
"""


@register("joint_documents", JOINT_DOCS_SQL)
def joint_documents(spark, sf):
    """E5 + D7 + D8 + J24: empirical joint over (lang, quality, toxic), empty cells as 0."""
    j = grid.empirical_joint(doc_units(spark, sf), DOC_STUDY, ["lang", "quality", "toxic"])
    return j.select(F.col("cell").cast("int").alias("cell"), r6("freq").alias("freq"))


PROP_DOCS_SQL = f"""
WITH {cte('u', DOC_UNITS_SQL)},
g AS (SELECT CAST(range AS INTEGER) AS lang FROM range(4)),
c AS (SELECT lang, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1 FROM u GROUP BY lang)
SELECT g.lang, CAST(coalesce(n0, 0) AS BIGINT) AS n0, CAST(coalesce(n1, 0) AS BIGINT) AS n1,
       round(CASE WHEN coalesce(n0, 0) + coalesce(n1, 0) > 0 THEN n0 / (n0 + n1) ELSE 0 END, 6) AS e0,
       round(CASE WHEN coalesce(n0, 0) + coalesce(n1, 0) > 0 THEN n1 / (n0 + n1) ELSE 0 END, 6) AS e1
FROM g LEFT JOIN c USING (lang)
"""


@register("propensity_documents", PROP_DOCS_SQL)
def propensity_documents(spark, sf):
    """E6 + D8: stratum propensity by counts over the full language grid."""
    p = grid.stratum_propensity(doc_units(spark, sf), DOC_STUDY, ["lang"], "quality")
    return p.select(F.col("lang").cast("int").alias("lang"), F.col("n0").cast("bigint").alias("n0"),
                    F.col("n1").cast("bigint").alias("n1"), r6("e0").alias("e0"), r6("e1").alias("e1"))


ATE_DOCS_SQL = f"""
WITH {cte('u', DOC_UNITS_SQL)},
s AS (SELECT lang, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1,
             sum(CASE WHEN quality = 1 THEN toxic ELSE 0 END) AS y1, sum(CASE WHEN quality = 0 THEN toxic ELSE 0 END) AS y0
      FROM u GROUP BY lang)
SELECT CAST(sum(n0 + n1) AS BIGINT) AS n,
       round(sum(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / (n1 / (n0 + n1)) - y0 / (n0 / (n0 + n1)) ELSE 0 END)
             / sum(n0 + n1), 6) AS ate_ipw,
       round(sum(y1) / sum(n1) - sum(y0) / sum(n0), 6) AS ate_naive
FROM s
"""


@register("ate_documents", ATE_DOCS_SQL)
def ate_documents(spark, sf):
    """J10 + E6-weighted IPW: does quality change toxicity, adjusting for language."""
    r = estimators.ipw_strata(doc_units(spark, sf), ["lang"], "quality", "toxic")
    return r.select(F.col("n").cast("bigint").alias("n"), r6("ate_ipw").alias("ate_ipw"),
                    r6("ate_naive").alias("ate_naive"))


# ------------------------------------------------------------------ sampling on the 7.1 unit table

N_TRIALS, TRIAL_SIZE, TRIAL_SEED = 3, 1000, 123


def _trial_rows_sql():
    u = sql_uniform_seed(f"{TRIAL_SEED} + tr.trial", "trial", "u.unit_id")
    return f"""
{cte('u', TB.UNITS_SQL)},
tu AS (SELECT u.*, CAST(tr.trial AS INTEGER) AS trial, {u} AS uu FROM u CROSS JOIN range({N_TRIALS}) AS tr(trial)),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY uu, unit_id) AS rn FROM tu)
        WHERE rn <= {TRIAL_SIZE}),
s AS (SELECT trial, segment, region, count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1,
             sum(CASE WHEN t = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN t = 0 THEN y ELSE 0 END) AS y0
      FROM sel GROUP BY trial, segment, region),
per AS (SELECT trial, sum(n0 + n1) AS n,
               sum(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / (n1 / (n0 + n1)) - y0 / (n0 / (n0 + n1)) ELSE 0 END)
                   / sum(n0 + n1) AS ate_ipw,
               sum(y1) / sum(n1) - sum(y0) / sum(n0) AS ate_naive
        FROM s GROUP BY trial)"""


TRIALS_SQL = f"""
WITH {_trial_rows_sql()}
SELECT trial, CAST(n AS BIGINT) AS n, round(ate_ipw, 6) AS ate_ipw, round(ate_naive, 6) AS ate_naive FROM per
"""


def _trial_ates(spark, sf):
    from causeway.plans.queries import units
    tr = sampling.trials(units(spark, sf), N_TRIALS, TRIAL_SIZE, TRIAL_SEED)
    return estimators.ipw_strata(tr, ["segment", "region"], "t", "y", by=["trial"])


@register("trials_orders", TRIALS_SQL)
def trials_orders(spark, sf):
    """I3 + K7: three keyed subsamples of 1000 units; IPW and naive ATE per trial, one job."""
    r = _trial_ates(spark, sf)
    return r.select(F.col("trial").cast("int").alias("trial"), F.col("n").cast("bigint").alias("n"),
                    r6("ate_ipw").alias("ate_ipw"), r6("ate_naive").alias("ate_naive"))


EVAL_SQL = f"""
WITH {_trial_rows_sql()},
full_s AS (SELECT segment, region, count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1,
                  sum(CASE WHEN t = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN t = 0 THEN y ELSE 0 END) AS y0
           FROM u GROUP BY segment, region),
g AS (SELECT sum(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / (n1 / (n0 + n1)) - y0 / (n0 / (n0 + n1)) ELSE 0 END)
             / sum(n0 + n1) AS g FROM full_s),
m AS (SELECT avg(ate_ipw) AS ate_mean, stddev_pop(ate_ipw) AS ate_std,
             avg((g - ate_naive) * (g - ate_naive)) AS cre_obs, avg((ate_naive - ate_ipw) * (ate_naive - ate_ipw)) AS obs_pred,
             2 * avg((g - ate_naive) * (ate_naive - ate_ipw)) AS err_corr, avg((g - ate_ipw) * (g - ate_ipw)) AS cre_pred
      FROM per CROSS JOIN g)
SELECT 'ipw' AS estimator, metric, round(value, 6) AS value FROM m
UNPIVOT (value FOR metric IN (ate_mean AS 'ATE_mean', ate_std AS 'ATE_std_dev', cre_obs AS 'CRE-Obs MSE',
                              obs_pred AS 'Obs-Pred MSE', err_corr AS 'Error Corr', cre_pred AS 'CRE-Pred MSE'))
"""


@register("evaluate_orders", EVAL_SQL)
def evaluate_orders(spark, sf):
    """E8 + K3 (+ K8 long form): trial summary and error decomposition.  Truth = full-table
    IPW ATE, observational = per-trial naive, prediction = per-trial IPW."""
    from causeway.plans.queries import units
    ates = _trial_ates(spark, sf)
    truth = estimators.ipw_strata(units(spark, sf), ["segment", "region"], "t", "y").select("ate_ipw").scalar()
    out = evaluate.trial_metrics(ates, truth, "ate_naive", "ate_ipw", "ate_ipw")
    return out.select(F.lit("ipw").alias("estimator"), "metric", r6("value").alias("value"))


# ------------------------------------------------------------------ K3-K7: all metrics of a trial

DRIVER_TRIALS, DRIVER_SIZE, DRIVER_SEED = 3, 300, 77
DRIVER_SHAPE = (4, 2, 2)


def _driver_sql():
    u = sql_uniform_seed(f"{DRIVER_SEED} + tr.trial", "trial", "e.unit_id")
    acc = " ".join(f"UNION ALL SELECT '{f}_acc_{k}_' || s, CASE s WHEN 'mean' THEN avg(h) ELSE stddev_pop(h) END FROM (SELECT trial, avg(CAST({f} = {c}_{f} AS DOUBLE)) AS h "
                   f"FROM j GROUP BY trial) CROSS JOIN (VALUES ('mean'), ('std')) v(s) GROUP BY s"
                   for f in ("x", "z", "y") for k, c in (("sample", "d"), ("max", "m")))
    return f"""
WITH {_softmax_sql(CELLS, 'pf')},
q AS (SELECT unit_id, (pos // 16) * 4 + pos % 4 AS pos, sum(p) AS p FROM pf GROUP BY ALL),
am AS (SELECT unit_id, min(pos) AS m FROM (SELECT *, max(p) OVER (PARTITION BY unit_id) AS mp FROM q) WHERE p = mp GROUP BY unit_id),
cum AS (SELECT unit_id, pos, sum(p) OVER (PARTITION BY unit_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM q),
dr AS (SELECT unit_id, coalesce(min(pos) FILTER (WHERE c > {sql_uniform(DRIVER_SEED, 'label', 'unit_id')}), 15) AS d FROM cum GROUP BY unit_id),
{_SAMPLES_SQL.strip()},
e AS (SELECT smp.unit_id, sample_a * 2 + sample_b AS x, sample_z AS z, CAST(label % 2 AS INTEGER) AS y, m, d
      FROM smp JOIN embeddings ON vec_id = smp.unit_id JOIN am USING (unit_id) JOIN dr USING (unit_id)),
j AS (SELECT trial, unit_id, x, z, y, m // 4 AS m_x, (m // 2) % 2 AS m_z, m % 2 AS m_y, d // 4 AS d_x, (d // 2) % 2 AS d_z, d % 2 AS d_y
      FROM (SELECT e.*, CAST(tr.trial AS INTEGER) AS trial, row_number() OVER (PARTITION BY tr.trial ORDER BY {u}, e.unit_id) AS rn
            FROM e CROSS JOIN range({DRIVER_TRIALS}) AS tr(trial)) WHERE rn <= {DRIVER_SIZE}),
n AS (SELECT trial, count(*) AS n FROM j GROUP BY trial),
g AS (SELECT trial, CAST(c.range AS INTEGER) AS pos FROM n CROSS JOIN range(16) c),
jp AS (SELECT trial, q.pos, avg(p) AS p FROM j JOIN q USING (unit_id) GROUP BY ALL),
jo AS (SELECT trial, x * 4 + z * 2 + y AS pos, count(*) AS c FROM j GROUP BY ALL),
cells AS (SELECT g.trial, g.pos, g.pos // 4 AS x, (g.pos // 2) % 2 AS z, g.pos % 2 AS y, jp.p, coalesce(jo.c, 0) / n.n AS o
          FROM g JOIN n USING (trial) JOIN jp USING (trial, pos) LEFT JOIN jo USING (trial, pos)),
xz AS (SELECT trial, x, z, sum(p) AS p, sum(o) AS o FROM cells GROUP BY ALL),
ez AS (SELECT trial, x, z, p / sum(p) OVER w AS ep, CASE WHEN sum(o) OVER w <> 0 THEN o / sum(o) OVER w ELSE 0 END AS eo
       FROM xz WINDOW w AS (PARTITION BY trial, x)),
ok AS (SELECT trial, x, min(eo) <> 0 AS fits FROM ez GROUP BY ALL),
ate AS (SELECT trial, sum((2 * z - 1) * y * p / ep) AS p, sum((2 * z - 1) * y * p) AS u,
               sum(CASE WHEN fits THEN (2 * z - 1) * y * o / eo ELSE 0 END) AS o
        FROM cells JOIN ez USING (trial, x, z) JOIN ok USING (trial, x) GROUP BY trial),
t0 AS (SELECT x, count(*) FILTER (WHERE z = 1) AS n1, count(*) FILTER (WHERE z = 0) AS n0, sum(y) FILTER (WHERE z = 1) AS s1,
              sum(y) FILTER (WHERE z = 0) AS s0 FROM e GROUP BY x),
tr AS (SELECT sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (n1 + n0) * (s1 / n1 - s0 / n0) ELSE 0 END) / sum(n1 + n0) AS g FROM t0),
dj AS (SELECT trial, sum(CASE WHEN o <> 0 THEN o * ln(o / (p + 1e-6)) ELSE 0 END) AS kl, avg((o - p) * (o - p)) AS mse FROM cells GROUP BY trial),
dp AS (SELECT trial, sum(CASE WHEN eo <> 0 THEN eo * ln(eo / (ep + 1e-6)) ELSE 0 END) AS kl, avg((eo - ep) * (eo - ep)) AS mse FROM ez GROUP BY trial),
r AS (SELECT 'ATE_mean' AS metric, avg(p) AS value FROM ate UNION ALL SELECT 'ATE_std_dev', stddev_pop(p) FROM ate
      UNION ALL SELECT 'Uncorrected_mean', avg(u) FROM ate
      UNION ALL SELECT 'CRE-Obs MSE', avg((g - o) * (g - o)) FROM ate, tr UNION ALL SELECT 'Obs-Pred MSE', avg((o - p) * (o - p)) FROM ate
      UNION ALL SELECT 'Error Corr', 2 * avg((g - o) * (o - p)) FROM ate, tr UNION ALL SELECT 'CRE-Pred MSE', avg((g - p) * (g - p)) FROM ate, tr
      UNION ALL SELECT 'KL to Obs Joint', avg(kl) FROM dj UNION ALL SELECT 'MSE to Obs Joint', avg(mse) FROM dj
      UNION ALL SELECT 'KL to Obs Propensity', avg(kl) FROM dp UNION ALL SELECT 'MSE to Obs Propensity', avg(mse) FROM dp
      {acc})
SELECT metric, round(value, 6) AS value FROM r
"""


def _labels(prefix, cell):
    return {prefix + "x": F.floor(cell / 4).cast("int"), prefix + "z": (F.floor(cell / 2) % 2).cast("int"), prefix + "y": (cell % 2).cast("int")}


@register("evaluate_trials_embeddings", _driver_sql())
def evaluate_trials_embeddings(spark, sf):
    """K3-K7: effects, error decomposition, joint and propensity distances and the accuracy of
    drawn and arg-max labels over three trials, from one grouped pass over (trial, unit)."""
    from causeway.functions.draws import uniform
    e = emb_units(spark, sf).join(TB.table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), "label"), "unit_id")
    e = e.withColumn("p16", A.marginal("p_full", (4, 4, 2, 2), (0, 2, 3)))
    e = e.select("unit_id", "p16", (F.col("sample_a") * 2 + F.col("sample_b")).alias("x"), F.col("sample_z").alias("z"),
                 (F.col("label") % 2).cast("int").alias("y"), A.argmax("p16").alias("top"),
                 A.draw_index("p16", uniform(DRIVER_SEED, "label", "unit_id")).alias("drawn"))
    e = e.withColumns(_labels("max_sample_", F.col("top")) | _labels("sample_", F.col("drawn")))
    e = e.withColumn("cell", F.col("x") * 4 + F.col("z") * 2 + F.col("y"))
    table = evaluate.trial_table(sampling.trials(e, DRIVER_TRIALS, DRIVER_SIZE, DRIVER_SEED), "p16", "cell", 16, ["x", "z", "y"])
    truth = estimators.ipw_strata(e, ["x"], "z", "y").select("ate_ipw").scalar()
    return evaluate.trial_report(table, DRIVER_SHAPE, truth).select("metric", r6("value").alias("value"))


#: Shares of the table.
SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED = 0.4, 0.4, 10

SPLIT_SQL = f"""
WITH {cte('u', TB.UNITS_SQL)},
c AS (SELECT t, y, count(*) AS n, CAST(floor(sum(count(*)) OVER () * CAST({SPLIT_TRAIN} AS DOUBLE)) AS BIGINT) AS nt,
             CAST(floor(sum(count(*)) OVER () * CAST({SPLIT_VAL} AS DOUBLE)) AS BIGINT) AS nv FROM u GROUP BY t, y),
a1 AS (SELECT *, (n * nt) // sum(n) OVER () AS base, (n * nt) % sum(n) OVER () AS rem FROM c),
a2 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, t, y) <= nt - sum(base) OVER ()
                        THEN 1 ELSE 0 END AS k_train FROM a1),
b1 AS (SELECT t, y, nv, k_train, n - k_train AS nr, ((n - k_train) * nv) // sum(n - k_train) OVER () AS base,
              ((n - k_train) * nv) % sum(n - k_train) OVER () AS rem FROM a2),
b2 AS (SELECT t, y, k_train, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, t, y)
                                      <= nv - sum(base) OVER () THEN 1 ELSE 0 END AS k_val FROM b1),
r AS (SELECT u.unit_id, u.t, u.y, row_number() OVER (PARTITION BY u.t, u.y ORDER BY {sql_uniform(SPLIT_SEED, 'split', 'u.unit_id')}, u.unit_id) AS rn
      FROM u)
SELECT r.unit_id, CASE WHEN rn <= k_train THEN 'train' ELSE 'val' END AS split
FROM r JOIN b2 USING (t, y) WHERE rn <= k_train + k_val
"""


@register("stratified_split_orders", SPLIT_SQL)
def stratified_split_orders(spark, sf):
    """Exact-size train/val split (two fifths each) stratified by treatment and outcome."""
    from causeway.plans.queries import units
    s = sampling.stratified_split(units(spark, sf), ["t", "y"], SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED)
    return s.select("unit_id", "split")


RESAMPLE_P, RESAMPLE_SEED = 0.3, 10


def _h_sql(seed, tag, e):
    return f"CAST(CAST(('0x' || substr(md5('{seed}:{tag}:' || CAST({e} AS VARCHAR)), 1, 8)) AS BIGINT) AS HUGEINT)"


RESAMPLE_SQL = f"""
WITH {cte('u0', TB.UNITS_SQL)},
u AS (SELECT unit_id, t, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS x,
             CAST(floor({sql_uniform(RESAMPLE_SEED, 'bucket', 'unit_id')}
                        * {sampling.BUCKETS}) AS INTEGER) AS bucket
      FROM u0),
cb AS (SELECT t, x, bucket, count(*) AS cnt FROM u GROUP BY t, x, bucket),
cbo AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY t, x ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS off FROM cb),
ranked AS (SELECT u.unit_id, u.t, u.x,
                  cbo.off + row_number() OVER (PARTITION BY u.t, u.x, u.bucket ORDER BY u.unit_id) - 1 AS rnk
           FROM u JOIN cbo USING (t, x, bucket)),
cells AS (SELECT t, x, sum(cnt) AS nc FROM cb GROUP BY t, x),
c2 AS (SELECT *, sum(CASE WHEN t = 1 THEN nc ELSE 0 END) OVER () AS n1, sum(CASE WHEN t = 0 THEN nc ELSE 0 END) OVER () AS n0,
              {int(round(RESAMPLE_P * 10000))} * (1 - x) + {10000 - int(round(RESAMPLE_P * 10000))} * x AS ex FROM cells),
c3 AS (SELECT *, CAST(CASE WHEN t = 1 THEN ex * n0 ELSE (10000 - ex) * n1 END AS HUGEINT) * CAST(nc AS HUGEINT) AS W FROM c2),
c4 AS (SELECT *, CAST(sum(W) OVER (ORDER BY t, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HUGEINT) AS hi,
              CAST(sum(W) OVER () AS HUGEINT) AS tot FROM c3),
c5 AS (SELECT *, hi - W AS lo FROM c4 WHERE W > 0),
d AS (SELECT unit_id AS draw_id FROM u),
dh AS (SELECT draw_id, {_h_sql(RESAMPLE_SEED, 'draw', 'draw_id')} AS h1,
              {_h_sql(RESAMPLE_SEED, 'pick_hi', 'draw_id')} * CAST(4294967296 AS HUGEINT)
              + {_h_sql(RESAMPLE_SEED, 'pick_lo', 'draw_id')} AS h64 FROM d),
dc AS (SELECT dh.draw_id, c5.t, c5.x, (dh.h64 * CAST(c5.nc AS HUGEINT)) // CAST('18446744073709551616' AS HUGEINT) AS rnk
       FROM dh JOIN c5 ON dh.h1 * c5.tot >= c5.lo * CAST(4294967296 AS HUGEINT)
                      AND dh.h1 * c5.tot < c5.hi * CAST(4294967296 AS HUGEINT))
SELECT dc.draw_id, ranked.unit_id FROM dc JOIN ranked ON dc.t = ranked.t AND dc.x = ranked.x AND dc.rnk = ranked.rnk
"""


@register("resample_orders", RESAMPLE_SQL)
def resample_orders(spark, sf):
    """Confounded resample with replacement (confounder: building segment, p = 0.3)."""
    from causeway.plans.queries import units
    u = units(spark, sf).withColumn("x", (F.col("segment") == "BUILDING").cast("int"))
    r = sampling.confounded_resample(u, "x", "t", RESAMPLE_P, RESAMPLE_SEED)
    return r.select("draw_id", "unit_id")
