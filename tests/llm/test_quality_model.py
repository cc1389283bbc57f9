"""Quality classifier: parts against their definitions, held-out accuracy on the table."""

import os

import numpy as np

from causeway.llm import quality_model as qm


def test_statistics():
    s = dict(zip(qm.STATISTICS, qm.statistics("AB cd cd\ncd!\n".encode())))
    assert abs(s["upper"] ** 2 - 2 / 13) < 1e-12 and abs(s["distinct"] - 3 / 4) < 1e-12 and abs(s["shouted"] - 1 / 4) < 1e-12
    assert abs(s["repeats"] - 1 / 4) < 1e-12 and not qm.statistics(b"").any() and np.isfinite(qm.statistics(b" \n ")).all()
    assert np.isfinite(qm.statistics(b"x " * 100_000)).all()


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 6, 12).astype(float)
        k = np.floor(rng.random(12) * (n + 1))
        x, v = qm.isotonic(np.arange(12.0), n, k)
        assert (np.diff(v) > 0).all() if len(v) > 1 else True
        # min-max formula of isotonic regression
        fit = [max(min(k[i:j + 1].sum() / n[i:j + 1].sum() for j in range(at, 12)) for i in range(at + 1)) for at in range(12)]
        assert np.allclose(sorted(set(np.round(fit, 9))), np.round(v, 9))


def test_fit_equals_one_machine_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(qm.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(l)) for r, l in zip(x, y)], "stats array<double>, label int").repartition(7)
    m = qm.fit(df, fourier=40)
    z = m.features(x)
    assert np.allclose(np.linalg.solve(z.T @ z + qm.RIDGE * 500 / 40 * np.eye(41), z.T @ y), m.beta, atol=1e-6)
    s = m.score(x)
    assert ((s >= 0) & (s <= 1)).all() and (np.argsort(m.raw(x), kind="stable") == np.argsort(s, kind="stable")).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "x", None), (3, "a b c " * 5000, "c"), (3, "a b c " * 5000, "c")],
                                 "doc_id long, text string, stats string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = qm.score_documents(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = qm.score_documents(docs, some).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert qm.score_documents(docs.limit(0), some).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    rows = qm.op3_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    one, zero = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in one for b in zero]) >= 0.95
