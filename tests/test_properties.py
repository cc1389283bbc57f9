"""Property tests: the Spark expressions against their plain-Python definitions on
generated inputs (each property checks a whole batch of examples in one Spark job)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import sampling

WS = list(T.PY_WHITESPACE)
PIECES = st.sampled_from(list("abcXYZé日1 ,.") + WS + ["&amp;", "&gt;", "&lt;"])
TEXTS = st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=1, max_size=60)


def _py_norm(s):
    s = s.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
    return s.replace("\n", " ").replace("\t", " ").strip()


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_word_count_and_normalise(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.word_count("t").alias("w"), T.normalise("t").alias("n"),
                     T.letter_count(T.normalise("t")).alias("l")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.w == len(t.split())
        assert r.n == _py_norm(t)
        assert r.l == sum(1 for c in _py_norm(t) if c.isalpha())


@settings(max_examples=5, deadline=None)
@given(TEXTS, st.lists(st.text(alphabet=st.sampled_from(list("abcxé")), min_size=1, max_size=3), min_size=1, max_size=8))
def test_term_matching(spark, texts, terms):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.matched_terms(["t"], terms).alias("m")).collect()
    for r in rows:
        hay = texts[r.i].lower()
        assert r.m == sorted({x.lower() for x in terms if x.lower() in hay})


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=5), min_size=1, max_size=300), st.integers(1, 50))
def test_take_smallest_any_group_sizes(spark, groups, k):
    from causeway.functions.draws import uniform
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "unit_id long, g int") \
        .withColumn("u", uniform(5, "p", "unit_id"))
    got = {r.unit_id for r in sampling.take_smallest(df, ["g"], k, "u", "unit_id", bins=16).collect()}
    pdf = df.toPandas().sort_values(["g", "u", "unit_id"])
    assert got == set(pdf.groupby("g").head(k)["unit_id"])
