"""Model-based estimators against MLlib, numpy least squares and direct formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import models


def units(n=3000, seed=0, cols=3, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, cols)).astype(float)
    x[:, 0] += shift * rng.random(n)
    e = 1 / (1 + np.exp(-(x[:, 0] - 0.7 * x[:, 1] + 0.2)))
    t = (rng.random(n) < e).astype(int)
    y = 1.5 * t + x @ np.array([0.5, -1.0, 0.3])[:cols] + 0.4 * t * x[:, 0] + rng.normal(size=n)
    return x, t, y


def frame(spark, x, t, y, **more):
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, r)) + (int(a), float(b)) for r, a, b in zip(x, t, y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", t int, y double"), cols


def logistic(x, t, penalty, penalise_intercept=False):
    """Plain gradient descent on the objective, far enough to compare."""
    z, b = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    r = np.full(len(b), penalty)
    r[0] *= penalise_intercept
    for _ in range(60):
        e = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (e * (1 - e))[:, None]).T @ z + np.diag(r), z.T @ (t - e) - r * b)
    return b


def brute(train, val, penalty):
    """All seven effects from the unit rows, with numpy least squares."""
    (x, t, y), (vx, vt, vy) = train, val
    b = logistic(x, t, penalty)
    score = lambda q: 1 / (1 + np.exp(-(b[0] + q @ b[1:])))
    e, ve, one = score(x), score(vx), lambda q: np.ones((len(q), 1))
    ls = lambda z, v, w=None: np.linalg.lstsq(z * np.sqrt(1 if w is None else w[:, None]), v * np.sqrt(1 if w is None else w), rcond=None)[0]
    w = np.where(t == 1, 1 / e, 1 / (1 - e))
    std = ls(np.hstack([one(x), x, t[:, None]]), y)
    imp = ls(np.hstack([one(x), x, t[:, None]]), y, w)
    feat = ls(np.hstack([one(x), x, t[:, None], w[:, None]]), y)
    a1, a0 = ls(np.hstack([one(x[t == 1]), x[t == 1]]), y[t == 1]), ls(np.hstack([one(x[t == 0]), x[t == 0]]), y[t == 0])
    zv = np.hstack([one(vx), vx])
    m0 = zv @ std[:-1]
    m1 = m0 + std[-1]
    return {"naive": vy[vt == 1].mean() - vy[vt == 0].mean(),
            "ipw": (vt * vy / ve).sum() / (vt / ve).sum() - ((1 - vt) * vy / (1 - ve)).sum() / ((1 - vt) / (1 - ve)).sum(),
            "standardization": std[-1], "strat_std": (zv @ (a1 - a0)).mean(),
            "dr_vanilla": (m1 - m0 + vt * (vy - m1) / ve - (1 - vt) * (vy - m0) / (1 - ve)).mean(),
            "dr_ipfeature": (feat[-2] + feat[-1] * (1 / ve - 1 / (1 - ve))).mean(), "dr_importance": imp[-1]}


@pytest.mark.parametrize("penalty", [0.0, 1.0, 25.0])
def test_fit_on_train_and_evaluate_on_val(spark, penalty):
    train, val = units(seed=1), units(800, seed=2)
    (df, cols), (dv, _) = frame(spark, *train), frame(spark, *val)
    both = df.withColumn("split", F.lit("train")).unionByName(dv.withColumn("split", F.lit("val"))).repartition(5)
    got = {(r.split, r.estimator): r.ate for r in models.benchmark(both, "split", {"train": "train", "val": "train"}, cols, "t", "y", penalty=penalty).collect()}
    for split, on in (("train", train), ("val", val)):
        want = brute(train, on, penalty)
        assert set(want) == set(models.ESTIMATORS)
        assert all(abs(got[split, k] - v) < 1e-8 for k, v in want.items()), (split, got, want)
    assert got["train", "ipw"] != got["val", "ipw"]


def test_propensity_equals_mllib(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    x, t, y = units(seed=3)
    df, cols = frame(spark, x, t, y)
    for penalty in (0.0, 1.0):
        m = LogisticRegression(featuresCol="f", labelCol="t", regParam=penalty / len(x), standardization=False, maxIter=500, tol=1e-14).fit(
            VectorAssembler(inputCols=cols, outputCol="f").transform(df))
        b = models.fit_propensity(models.design_cells(df, cols, "t", "y"), penalty)
        assert np.allclose(b, [m.intercept, *m.coefficients.toArray()], atol=2e-6)
        assert np.allclose(b, logistic(x, t, penalty), atol=1e-9)
    b = models.fit_propensity(models.design_cells(df, cols, "t", "y"), 5.0, penalise_intercept=True)
    assert np.allclose(b, logistic(x, t, 5.0, True), atol=1e-9)


def test_cells_summed_where_they_lie(spark):
    """Many distinct patterns (a continuous covariate): distributed sums equal local ones."""
    x, t, y = units(700, seed=4, shift=1.0)
    df, cols = frame(spark, x, t, y)
    near, far = models.design_cells(df, cols, "t", "y"), models.design_cells(df.repartition(6), cols, "t", "y", local=10)
    assert near.local is not None and far.local is None
    a, b = models.fit(near), models.fit(far)
    assert np.allclose(a.propensity, b.propensity, atol=1e-9)
    ea, eb = models.effects(a, near), models.effects(b, far)
    assert all(abs(ea[k] - eb[k]) < 1e-9 for k in ea)
    want = brute((x, t, y), (x, t, y), 1.0)
    assert all(abs(ea[k] - want[k]) < 1e-8 for k in want)


def test_fitted_table_round_trip(spark):
    x, t, y = units(500, seed=5)
    df, cols = frame(spark, x, t, y)
    cells = models.design_cells(df, cols, "t", "y")
    f = models.fit(cells, 2.0)
    table = f.table(spark)
    g = models.Fitted.from_table(table.repartition(3))
    assert g.x_cols == tuple(cols) and g.penalty == 2.0 and models.effects(g, cells) == models.effects(f, cells)
    assert {r.model for r in table.collect()} == {"propensity", "standardization", "dr_ipfeature", "dr_importance", "arm1", "arm0"}
    with pytest.raises(ValueError, match="fitted on"):
        models.effects(g, models.design_cells(df, cols[:2], "t", "y"))


def test_dependent_covariates_and_nulls(spark):
    x, t, y = units(600, seed=6)
    x = np.hstack([x, x[:, :1], np.ones((600, 1))])        # a repeated and a constant covariate
    df, cols = frame(spark, x, t, y)
    clean = models.compare(df, cols, "t", "y").collect()
    want = brute((x, t, y), (x, t, y), 1.0)
    assert all(abs(r.ate - want[r.estimator]) < 1e-6 for r in clean)
    holes = df.unionByName(df.limit(9).withColumn("y", F.lit(None).cast("double"))).unionByName(df.limit(5).withColumn("c0", F.lit(None).cast("double")))
    assert [tuple(r) for r in models.compare(holes, cols, "t", "y").collect()] == [tuple(r) for r in clean]


def test_nothing_to_fit_is_an_error(spark):
    df, cols = frame(spark, *units(50, seed=7))
    with pytest.raises(ValueError):
        models.compare(df.limit(0), cols, "t", "y")
    with pytest.raises(ValueError, match="no units"):
        models.benchmark(df.withColumn("split", F.lit("train")), "split", {"train": "train", "val": "train"}, cols, "t", "y")
    sep = df.withColumn("c0", F.col("t").cast("double"))
    with pytest.raises(ValueError, match="separates"):
        models.compare(sep, cols, "t", "y", penalty=0.0)
    assert len(models.compare(sep, cols, "t", "y", penalty=1.0).collect()) == 7
