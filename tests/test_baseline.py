"""Bag of words against Python's counts; the perceptron's gradients; the search's table."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from causeway.operators import baseline as BL


def test_bag_of_words(spark):
    texts = ["The cat and the CAT_2", "été l'école a b", None, "", "x1 x1 _ __ 日本語", "unseen cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    vocab = BL.vocabulary(df.where("id < 5"), "text")
    names = {r["index"]: r.term for r in vocab.collect()}
    token = lambda t: re.findall(r"\w\w+", (t or "").lower())
    assert sorted(names) == list(range(len(names))) and set(names.values()) == {w for t in texts[:5] for w in token(t)}
    got = {}
    for r in BL.bag_of_words(df, vocab, "id", "text").collect():
        got.setdefault(r.id, Counter())[names[r["index"]]] = r.n
    want = {i: c for i, t in enumerate(texts) if (c := Counter(w for w in token(t) if w in set(names.values())))}
    assert got == want


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    for act in ("tanh", "relu"):
        net = BL.Perceptron(["a", "b", "c"], act, [(rng.normal(size=(4, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))])

        def loss():
            z = net.forward(x)[-1]
            return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(7), y].mean() + 1e-4 / 7 / 2 * sum((w ** 2).sum() for w, _ in net.layers)
        for layer, grad in zip(net.layers, net.gradients(x, y)):
            for p, g in zip(layer, grad):
                for at in np.ndindex(p.shape):
                    p[at] += 1e-6
                    up = loss()
                    p[at] -= 2e-6
                    assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
                    p[at] += 1e-6


def test_both_solvers_and_activations_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    for s in BL.settings({"hidden": (32,), "depth": (2,), "activation": ("tanh", "relu"), "step": (5e-3,), "batch": (32,), "solver": ("sgd", "adam")}):
        net = BL.fit_perceptron(x, y, ["0", "1"], s, 3, max_iter=60)
        assert (net.predict(x) == y).mean() > (0.9 if s["solver"] == "adam" else 0.75), s


def test_search_is_whole_and_stable(spark, tmp_path):
    assert len(BL.settings()) == 144
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist(), None if i % 20 == 0 else "ab"[i % 2]) for i in range(120)]
    rows = [(i, [v + (3 if lab == "b" else 0) for v in x], lab) for i, x, lab in rows] + [(500, None, "a")]
    df = spark.createDataFrame(rows, "id int, f array<double>, lab string")
    grid = {"hidden": (8, 16), "depth": (2,), "activation": ("tanh", "relu"), "step": (5e-3,), "batch": (32,), "solver": ("sgd", "adam")}
    take = lambda d: sorted(map(tuple, BL.grid_search(d, "id", "f", ["lab"], 3, grid).collect()))
    a = take(df)
    assert len(a) == 8 * 3 and a == take(df.repartition(7)) and all(0 <= r[3] <= 1 for r in a)
    best = BL.best_settings(BL.grid_search(df, "id", "f", ["lab"], 3, grid))
    models = BL.fit_fields(df, "id", "f", best, grid)
    BL.save_models(models, str(tmp_path / "m"))
    pred = BL.predict_fields(BL.load_models(spark, str(tmp_path / "m")), df, "f")
    assert pred.where("id = 500 and pred_lab is null").count() == 1
    assert BL.field_accuracy(pred, ["lab"], "train").first().acc > 0.8
    assert BL.grid_search(df.where(F.lit(False)), "id", "f", ["lab"], 2, grid).where("accuracy is not null").count() == 0
