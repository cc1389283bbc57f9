"""Language identification: the kernel against sets, the fit against kernel ridge, held-out accuracy."""

import zlib

import numpy as np

from causeway.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string"


def grams_of(text, n):
    """Distinct n-grams, by Python sets."""
    raw = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in text.lower())
    x = (" " + " ".join(raw.split(" ")) + " ").encode()
    while b"  " in x:
        x = x.replace(b"  ", b" ")
    return {x[i:i + n] for i in range(len(x) - n + 1)}


def test_kernel_equals_sets():
    texts = ["The quick brown fox", "der schnelle braune Fuchs, 3 Mal!", "", "été à l'école", "日本語", "a", "THE the ThE 99", "x " * 500]
    number = [[{int.from_bytes(g, "little") for g in grams_of(t, n)} for t in texts] for n in li.ORDERS]
    for t, c in zip(texts, map(li.codes, texts)):
        assert [set(x.tolist()) for x in c] == [number[k][texts.index(t)] for k in range(4)]
    everything = [li.Grams(np.array(sorted(set().union(*s)), np.uint32)) for s in number]
    assert all(len(g.grams) >= 0.98 * len(set().union(*s)) for g, s in zip(everything, number))
    held = [set(g.grams.tolist()) for g in everything]
    got = li.kernel(li.presence(everything, texts), li.presence(everything, texts))
    for i in range(len(texts)):
        for j in range(len(texts)):
            want = np.mean([len(s[i] & s[j] & h) / max(1, np.sqrt(len(s[i] & h) * len(s[j] & h))) for s, h in zip(number, held)])
            assert abs(got[i, j] - want) < 1e-6


def test_all_landmarks_is_kernel_ridge():
    """With every sample row a landmark, the fit is ordinary kernel ridge regression."""
    rng = np.random.default_rng(3)
    x = [(rng.random((30, 50)) < 0.3).astype(np.float32) for _ in li.ORDERS]
    k, y = li.kernel(x, x), np.arange(30) % 3
    w = li.fit_ridge(k, k, y, 3)
    dual = np.linalg.solve(k / 30 + li.RIDGE * np.eye(30), (2.0 * (y[:, None] == np.arange(3)) - 1) / 30)
    assert np.allclose(k @ w, k @ dual, atol=1e-6)


LINES = {"en": "the house and the garden of the old king were in the valley ", "de": "das Haus und der Garten des alten Königs lagen in dem Tal ",
         "ru": "дом и сад старого короля были в долине у реки "}


def corpus(n=120):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(n):
        lang = sorted(LINES)[d % 3]
        w = LINES[lang].split()
        rows.append((d, " ".join(rng.choice(w, 1 + d % 40)), lang))
    return rows


def test_edges_and_learned_rows(spark):
    rows = corpus()
    # labels of the held-out rows and of rows without an id, label or text teach nothing
    bad = [(d, t, "xx") for d, t, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    extra = [(None, "the garden", "yy"), (700, None, "zz"), (701, "the garden", None), (702, "", None), (703, "12 -- 34", None), (None, "des alten Königs", None),
             (704, "the old king", None), (704, "the old king", None), (705, "Ω", None), (706, "the garden " * 50_000, None)]
    df = spark.createDataFrame(rows + bad + extra, SCHEMA).repartition(3)
    model = li.fit(df, per_language=30, landmarks=12, grams=300)
    assert model.languages == ["de", "en", "ru"]
    got = li.identify(df, model).collect()
    assert len(got) == len(rows + bad + extra) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    truth = {d: l for d, _, l in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth]) == 1
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, rs in by.items() for r in rs if d is not None)
    assert all(by[k][0].lang_pred == "und" and by[k][0].score == 0 for k in (700, 702, 703))
    assert [r.lang_pred for r in by[704]] == ["en", "en"] and by[705][0].lang_pred in truth.values() and by[706][0].lang_pred == "en"
    assert {(r.held_out, r.lang_pred) for r in by[None]} == {(False, "en"), (False, "de")}


def test_nothing_learned_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], SCHEMA)
    assert li.identify(empty, li.fit(empty)).count() == 0
    unlabelled = spark.createDataFrame([(1, "the house", None)], SCHEMA).select("*", F.lit(1).alias("n"), F.lit(2).alias("place"), F.lit(3).alias("score"), F.lit(4).alias("draw"))
    assert [tuple(r)[2:] for r in li.identify(unlabelled, li.fit(unlabelled)).collect()] == [("und", 0.0)]
    rows = spark.createDataFrame(corpus(60), SCHEMA).select("*", F.lit(1).alias("n"), F.lit(2).alias("place"), F.lit(3).alias("score"), F.lit(4).alias("draw"))
    assert li.identify(rows, li.fit(rows, per_language=10, landmarks=6, grams=200)).count() == 60


def test_sample_is_bounded_and_stable(spark):
    df = spark.createDataFrame([(d, "t", "en" if d % 10 else "de") for d in range(5000)] + [(7, "t", "en")] * 500, SCHEMA)
    take = lambda x: sorted(map(tuple, li.training_sample(x, 40).groupBy("lang").count().collect()))
    assert take(df) == take(df.repartition(9)) and all(n <= 40 for _, n in take(df)) and dict(take(df))["de"] == 40


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    from causeway.llm.common import read
    rows = li.op13_language_id(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
