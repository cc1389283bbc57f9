"""Hand-computed micro-fixtures for the edge rules (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import codes as C
from causeway.functions import text as T
from causeway.operators import clean, discretize, distributions, estimators, evaluate
from causeway.spec import LIRAGLUTIDE, TIRZEPATIDE


def one(spark, *exprs):
    return spark.range(1).select(*exprs).collect()[0]


def test_tombstones_and_length(spark):
    df = spark.createDataFrame([("[deleted]",), ("[removed]",), ("ok text",)], "t string")
    assert [r.t for r in df.where(T.not_tombstone("t")).collect()] == ["ok text"]
    words = spark.createDataFrame([(" ".join(["w"] * 9),), (" ".join(["w"] * 10),), ("  ".join(["w"] * 10),)], "t string")
    assert [r.ok for r in words.select(T.long_enough("t").alias("ok")).collect()] == [False, True, True]


def test_bot_author(spark):
    df = spark.createDataFrame([("AutoBOT",), ("ann",), (None,)], "a string")
    assert [r.ok for r in df.select(T.human_author("a").alias("ok")).collect()] == [False, True, False]


def test_word_break_and_alpha_ratio(spark):
    df = spark.createDataFrame([("",), ("x" * 2048 + " y",), ("a b",)], "t string")
    got = [r.ok for r in df.select(T.has_word_break(T.normalise("t")).alias("ok")).collect()]
    assert got == [False, False, True]
    df = spark.createDataFrame([("ab 1",), ("a 12",), ("éà 1",)], "t string")
    got = [r.ok for r in df.select(T.alpha_ratio_ok(T.normalise("t")).alias("ok")).collect()]
    assert got == [True, False, True]


def test_normalise_python_strip(spark):
    r = one(spark, T.normalise(F.lit("  &amp;gt; x\n\t　")).alias("n"))
    assert r.n == "&gt; x"


def test_word_count_matches_python_split(spark):
    texts = ["a  b\tc", "x y z", "", "  lead trail  ", "one\x1ctwo"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(T.word_count("t").alias("n")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_overlapping_terms(spark):
    r = one(spark, T.matched_terms([F.lit("Topamax")], ["topama", "topamax", "botox"]).alias("m"))
    assert r.m == ["topama", "topamax"]


def test_verdicts(spark):
    df = spark.createDataFrame([("Yes",), ("yes.",), ("yes and no",)], "a string")
    rows = df.select(T.strict_yes("a").alias("s"), T.lenient_yes("a").alias("l")).collect()
    assert [r.s for r in rows] == [True, False, False]
    assert [r.l for r in rows] == [True, True, False]


def test_thread_key_and_date(spark):
    r = one(spark, T.thread_key(F.lit("/r/m/comments/abc/slug/"), False).alias("s"),
            T.thread_key(F.lit("/r/m/comments/abc/slug/def/"), True).alias("c"),
            T.utc_date(F.lit(1669075200)).alias("d"))
    assert (r.s, r.c, r.d) == ("slug", "slug", "November 22, 2022")


def test_lenient_number_and_bins(spark):
    r = one(spark, C.to_number(F.lit("abc")).alias("a"), C.to_number(F.lit("12.5")).alias("b"))
    assert r.a is None and r.b == 12.5
    edges = [0, 263, 396, 611, 7694.1]
    df = spark.createDataFrame([(0.0,), (263.0,), (264.0,), (7694.0,), (9000.0,)], "x double")
    assert [r.b for r in df.select(C.right_closed_bin("x", edges).alias("b")).collect()] == [None, 0, 1, 3, None]


def _clinical_row(spark, **kw):
    cols = ["unit_id", "drug_type", "age", "sex", "country", "t2dm", "metformin", "bmi", "start_HbA1c", "end_HbA1c",
            "start_weight", "end_weight", "weight_unit", "weight_change", "percentage_weight_change", "duration_days",
            "dosage"]
    row = {c: None for c in cols}
    row["unit_id"] = 1
    row.update(kw)
    schema = ", ".join(f"{c} {'bigint' if c == 'unit_id' else 'string'}" for c in cols)
    return spark.createDataFrame([tuple(row[c] for c in cols)], schema)


def test_kg_change_pct_target(spark):
    df = _clinical_row(spark, drug_type="Mounjaro", weight_unit="kg", start_weight="100", end_weight="94")
    r = discretize.discretize_clinical(df, TIRZEPATIDE, mode="soft").collect()[0]
    assert r.weight_change == pytest.approx(-13.22772)
    assert r.percentage_weight_change == pytest.approx(-6.0)
    assert r.target_achieved == 1 and r.drug_type == 1
    df = _clinical_row(spark, drug_type="Ozempic")
    r = discretize.discretize_clinical(df, TIRZEPATIDE, mode="soft").collect()[0]
    assert r.target_achieved == 0


def test_inclusion_criteria(spark):
    cases = [dict(drug_type="Ozempic", start_weight="200", end_weight="180"),                 # all unknown -> keep
             dict(drug_type="Ozempic", start_weight="200", end_weight="180", start_HbA1c="6.9"),  # drop
             dict(drug_type="Saxenda", start_weight="200", end_weight="180", dosage="1.2"),  # keep
             dict(drug_type="Ozempic", start_weight="200", end_weight="180", dosage="1.2")]  # drop
    kept = []
    for c in cases:
        df = _clinical_row(spark, **c)
        kept.append(discretize.discretize_clinical(df, LIRAGLUTIDE, mode="hard").count() == 1)
    assert kept == [True, False, True, False]


def test_coalesce_known(spark):
    known = spark.createDataFrame([(1, 1.0, None)], "id bigint, a double, b double")
    inferred = spark.createDataFrame([(1, 9.0, 8.0)], "id bigint, a double, b double")
    r = discretize.coalesce_known(known, inferred, "id", ["a", "b"]).collect()[0]
    assert (r.a, r.b) == (1.0, 8.0)


def test_softmax_argmax_draw(spark):
    r = one(spark, A.softmax(F.array(F.lit(0.0), F.lit(math.log(3)))).alias("p"),
            A.argmax(F.array(F.lit(0.0), F.lit(0.0))).alias("tie"))
    assert r.p == pytest.approx([0.25, 0.75]) and r.tie == 0
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    r = one(spark, *[A.draw_index(p, F.lit(u)).alias(f"d{i}") for i, u in enumerate([0.1, 0.2, 0.69, 0.99])])
    assert list(r) == [0, 1, 1, 2]


def test_nucleus(spark):
    df = spark.createDataFrame([(1, [0.5, 0.3, 0.2]), (2, [0.2, 0.5, 0.3]), (3, [0.4, 0.2, 0.4]), (4, [1.0])], "u bigint, p array<double>")
    k = {r.u: r.nucleus for r in distributions.nucleus(df, "p", 0.5).collect()}
    assert [e.idx for e in k[1]] == [0, 1] and [e.p for e in k[1]] == pytest.approx([0.625, 0.375])
    assert [e.idx for e in k[2]] == [1, 2] and [e.idx for e in k[3]] == [0, 2] and [e.p for e in k[4]] == [1.0]     # ties by index
    cut = distributions.nucleus(df, "p", 0.4)
    assert {r.u: [e.idx for e in r.nucleus] for r in cut.collect()}[1] == [0]
    drawn = distributions.nucleus_draw(cut, "u", 3)
    assert "Exchange" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert {r.u: (r.n_kept, r.drawn) for r in drawn.collect()}[1] == (1, 0)


def test_marginal_by_axes(spark):
    import numpy as np
    x = np.arange(1.0, 49.0).reshape(2, 3, 4, 2)
    col = F.array(*[F.lit(float(v)) for v in x.ravel()])
    for keep in ((0,), (1, 3), (0, 2), (2,), (0, 1, 2, 3), ()):
        drop = tuple(a for a in range(4) if a not in keep)
        assert one(spark, A.marginal(col, x.shape, keep).alias("m")).m == pytest.approx(x.sum(axis=drop).ravel().tolist())


def test_trial_std_and_kl(spark):
    ates = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "p double, o double")
    s = {r.metric: r.value for r in evaluate.trial_metrics(ates, 0.0, "o", "p", "x").collect()}
    assert s["ATE_mean"] == 2.0 and s["ATE_std_dev"] == 1.0
    r = one(spark, A.kl(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("k"))
    assert r.k == pytest.approx(-2e-6, rel=1e-3)


def test_full_joint_ipw_zero_effect(spark):
    df = spark.createDataFrame([(1, [0.25, 0.25, 0.25, 0.25])], "u bigint, p array<double>")
    r = estimators.ipw_full(df, "p", 2, 2).collect()[0]
    assert r.ate == pytest.approx(0.0)
    e = estimators.full_joint_propensity(df, "p", 2, 2).collect()[0]
    assert (e.e0, e.e1) == (0.5, 0.5)


def test_hybrid_ipw(spark):
    df = spark.createDataFrame([(1, 0, [0.4, 0.1, 0.1, 0.4]), (2, 0, [0.4, 0.1, 0.1, 0.4])],
                               "u bigint, s int, p array<double>")
    r = estimators.ipw_hybrid(df, "p", ["s"]).collect()[0]
    assert r.ate == pytest.approx(0.6) and r.uncorrected == pytest.approx(0.3)


def test_outcome_imputation_weights(spark):
    rows = [("A", 0, 0.2)] + [("A", 1, 0.4)] * 3 + [("B", 0, 0.6)] * 3 + [("B", 1, 0.8)]
    df = spark.createDataFrame([(i, s, z, [1 - y1, y1]) for i, (s, z, y1) in enumerate(rows)],
                               "u bigint, s string, z int, p array<double>")
    arm = estimators.outcome_imputation(df, "p", ["s"], "z", "arm").collect()[0].ate
    marg = estimators.outcome_imputation(df, "p", ["s"], "z", "marginal").collect()[0].ate
    assert arm == pytest.approx(0.0) and marg == pytest.approx(0.2)


def test_completion_trim(spark):
    df = spark.createDataFrame([([9, 9, 5, 6, 0, 7],)], "t array<int>")
    r = df.select("t", A.trim_completion("t", 2, 3, [0]).alias("r")).select(
        F.slice("t", F.col("r.start") + 1, F.col("r.length")).alias("k")).collect()[0]
    assert r.k == [5, 6]


def test_one_pass_equals_per_term_scan(spark, sf_dir):
    import random
    rnd = random.Random(3)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicons = [["th", "the", "then", "ation", "tion", "on", "eau", "q", ".", "(", "[a]", "\\d", "é", " a "], ["topama", "topamax", "botox", ""], ["x"], []]
    lexicons += [["".join(rnd.choice("thean o") for _ in range(rnd.randint(1, 5))) for _ in range(40)] for _ in range(3)]
    for terms in lexicons:
        both = d.select(T.matched_terms(["text"], terms).alias("a") if terms else F.array().cast("array<string>").alias("a"),
                        T.matched_terms_one_pass(["text"], terms).alias("b"))
        assert both.where("a <> b OR b IS NULL").count() == 0, terms
    r = one(spark, T.matched_terms_one_pass([F.lit("Topamax"), F.lit(None)], ["topama", "TOPAMAX", "botox", "max"]).alias("m"))
    assert r.m == ["max", "topama", "topamax"]
