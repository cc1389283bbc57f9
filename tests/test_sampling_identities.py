"""Sampling against brute force (including a hot group holding a third of the rows),
invariance to repartitioning, and estimator identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.draws import uniform
from causeway.operators import estimators, grid, sampling
from causeway.plans.q_effects import DOC_STUDY


def _skewed(spark, n=3000):
    # group 0 holds a third of all rows
    return spark.range(n).select(F.col("id").alias("unit_id"),
                                 F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).alias("g"))


def test_take_smallest_matches_brute_force(spark):
    df = _skewed(spark).withColumn("u", uniform(7, "t", "unit_id"))
    got = sampling.take_smallest(df, ["g"], 40, "u", "unit_id", bins=64)
    pdf = df.toPandas().sort_values(["g", "u", "unit_id"])
    want = set(pdf.groupby("g").head(40)["unit_id"])
    assert set(r.unit_id for r in got.collect()) == want


def test_trials_invariant_to_partitioning(spark):
    df = _skewed(spark)
    a = sampling.trials(df, 3, 100, 123).select("trial", "unit_id")
    b = sampling.trials(df.repartition(7), 3, 100, 123).select("trial", "unit_id")
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r.trial: r.n for r in a.groupBy("trial").agg(F.count("*").alias("n")).collect()} == {0: 100, 1: 100, 2: 100}


def test_stratified_split_sizes(spark):
    df = _skewed(spark).withColumn("t", (F.col("unit_id") % 2).cast("int"))
    s = sampling.stratified_split(df, ["t", "g"], 300, 200, 10)
    counts = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 300, "val": 200}
    again = sampling.stratified_split(df.repartition(5), ["t", "g"], 300, 200, 10)
    assert sorted(s.select("unit_id", "split").collect()) == sorted(again.select("unit_id", "split").collect())


def test_confounded_resample_distribution(spark):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("unit_id"), (F.col("id") % 2).cast("int").alias("x"),
                               ((F.col("id") / 2) % 2).cast("int").alias("t"))
    r = sampling.confounded_resample(df, "x", "t", 0.3, seed=1, buckets=16)
    assert r.count() == n
    again = sampling.confounded_resample(df.repartition(3), "x", "t", 0.3, seed=1, buckets=16)
    assert sorted(r.select("draw_id", "unit_id").collect()) == sorted(again.select("draw_id", "unit_id").collect())
    share = r.where("t = 1").agg(F.avg("x")).collect()[0][0]   # treated units favour x = 1 (ex = 0.7)
    assert 0.65 < share < 0.75


def test_full_joint_ipw_equals_literal_loop(spark):
    rng = np.random.default_rng(0)
    arrs = rng.dirichlet(np.ones(8), size=50)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(arrs)], "u bigint, p array<double>")
    got = estimators.ipw_full(df, "p", 2, 2).collect()[0].ate
    p = arrs.reshape(50, 2, 2, 2)
    marg = p.sum(axis=3).mean(axis=0)                     # [x, z]
    e = marg / marg.sum(axis=1, keepdims=True)
    treat = control = 0.0
    for j in range(50):
        for z in range(2):
            for y in range(2):
                for x in range(2):
                    if 0 not in e[x]:
                        treat += z * y * p[j, x, z, y] / e[x, 1]
                        control += (1 - z) * y * p[j, x, z, y] / e[x, 0]
    assert got == pytest.approx((treat - control) / 50)


def test_joint_sums_to_one(spark):
    df = spark.createDataFrame([(i, i % 4, i % 2, (i // 2) % 2) for i in range(37)],
                               "unit_id bigint, lang int, quality int, toxic int")
    j = grid.empirical_joint(df, DOC_STUDY, ["lang", "quality", "toxic"])
    assert j.count() == 16
    assert j.agg(F.sum("freq")).collect()[0][0] == pytest.approx(1.0)


def test_error_decomposition_sums(spark):
    from causeway.operators import evaluate
    ates = spark.createDataFrame([(0.1, 0.3), (0.2, 0.1), (0.05, 0.2)], "o double, p double")
    m = {r.metric: r.value for r in evaluate.trial_metrics(ates, 0.15, "o", "p", "x").collect()}
    assert m["CRE-Obs MSE"] + m["Obs-Pred MSE"] + m["Error Corr"] == pytest.approx(m["CRE-Pred MSE"])


def test_row_local_draws_invariant_to_partitioning(spark, sf_dir):
    from causeway.operators import discretize
    from causeway.plans import tables as TB
    a = TB.derived(spark, sf_dir, TB.EMAIL_ANSWERS_SQL, TB.EMAIL_NEEDS)
    one = discretize.discretize_email(a, seed=10).collect()
    two = discretize.discretize_email(a.repartition(7), seed=10).collect()
    assert sorted(one) == sorted(two)
    t1 = sampling.assign_traits(a.select("unit_id"), 0.5, 4, "unit_id").collect()
    t2 = sampling.assign_traits(a.select("unit_id").repartition(5), 0.5, 4, "unit_id").collect()
    assert sorted(t1) == sorted(t2)


def test_columnwise_and_exploded_array_totals_agree(spark):
    rng = np.random.default_rng(1)
    arrs = rng.dirichlet(np.ones(8), size=40)
    df = spark.createDataFrame([(i, i % 3, a.tolist()) for i, a in enumerate(arrs)], "u bigint, g int, p array<double>")
    a = sorted((r.g, r.pos, round(r.s, 9), r.n) for r in grid.array_totals(df, "p", ["g"]).collect())
    b = sorted((r.g, r.pos, round(r.s, 9), r.n) for r in grid.array_totals(df, "p", ["g"], size=8).collect())
    assert a == b
    x = estimators.ipw_full(df, "p", 2, 2).collect()[0]
    y = estimators.ipw_full(df, "p", 2, 2, size=8).collect()[0]
    assert x.ate == pytest.approx(y.ate) and x.n == y.n


def test_split_needs_enough_rows(spark):
    """A table too small for both parts is an error; shares always fit; NULL strata are strata."""
    import pytest
    from causeway.operators import sampling
    df = spark.range(100).selectExpr("id AS unit_id", "CASE WHEN id % 4 < 3 THEN id % 4 END AS t")
    with pytest.raises(Exception, match="split of 120 rows from 100"):
        sampling.stratified_split(df, ["t"], 60, 60, 1).collect()
    for train, val, want in ((60, 40, (60, 40)), (0.5, 0.25, (50, 25)), (1, 1, (1, 1))):
        got = sampling.stratified_split(df, ["t"], train, val, 1).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == dict(zip(("train", "val"), want))
    assert sampling.stratified_split(df, ["t"], 0.5, 0.5, 1).where("t is null").count() == 25


def test_resample_is_one_plan(spark):
    """No count, no cache; every drawn unit exists; the draws do not change with the row order."""
    from causeway.operators import sampling
    df = spark.range(2000).selectExpr("id AS unit_id", "CAST(id % 2 AS INT) AS t", "CAST(id % 3 = 0 AS INT) AS x")
    a = sampling.confounded_resample(df, "x", "t", 0.3, 5)
    assert "InMemory" not in a._jdf.queryExecution().executedPlan().toString()
    pick = lambda q: sorted((r.draw_id, r.unit_id) for r in q.select("draw_id", "unit_id").collect())
    assert len(pick(a)) == 2000 and pick(a) == pick(sampling.confounded_resample(df.repartition(7), "x", "t", 0.3, 5))
