"""Digest lookups, key alignment, numbered domains and rule bounds on small tables."""

import pytest
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import clean, sampling


def test_lookup_first_sample(spark):
    posts = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, None, "r"), (4, "a", "s"), (5, "", "t")], "post int, text string, more string")
    samples = spark.createDataFrame([(20, "a", 7), (10, "a", 8), (30, "c", 9), (40, None, 1), (50, "", 2)], "sid int, text string, val int").repartition(3)
    for verify in (True, False):
        got = {r.post: (r.more, r.first_sid, r.first_val) for r in clean.lookup_first(posts, samples, "text", "sid", ["sid", "val"], verify).collect()}
        assert got == {1: ("p", 10, 8), 2: ("q", None, None), 3: ("r", None, None), 4: ("s", 10, 8), 5: ("t", 50, 2)}
    assert clean.lookup_first(posts, samples.limit(0), "text", "sid", ["val"]).where("first_val is null").count() == 5


def test_keep_first_text(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (5, None, "w"), (4, "", "v")], "id int, text string, tag string").repartition(3)
    got = sorted(map(tuple, clean.keep_first_text(df, "text", "id", {"n": F.count("*")}, ["tag"]).select("id", "tag", "n").collect()))
    assert got == [(1, "y", 2), (2, "z", 2), (4, "v", 1)]
    assert sorted(r.id for r in clean.keep_first_text(df, "text", "id").collect()) == [1, 2, 4]


def test_align(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.1), (None, 0.9)], "unit_id int, p double")
    b = spark.createDataFrame([(2, "x"), (3, None)], "unit_id int, c string")
    got = sorted(map(tuple, clean.align(a, b).select("unit_id", "p", "c", "side").collect()))
    assert got == [(1, 0.5, None, "left"), (2, 0.1, "x", "both"), (3, None, None, "right")]
    with pytest.raises(Exception, match="repeated key 2"):
        clean.align(a.unionByName(a.where("unit_id = 2")), b).collect()
    with pytest.raises(ValueError, match="both tables have"):
        clean.align(a, a)
    assert clean.align(a.limit(0), b).where("side = 'right'").count() == 2


def test_domain_numbers_every_value_once(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE id % 700 END AS v", "id").repartition(5)
    d = sampling.domain(df, "v", 4).collect()
    assert sorted(r.k for r in d) == list(range(700)) and {r.value for r in d} == set(range(700)) and {r["size"] for r in d} == {700}
    drawn = sampling.draw_from_domain(df, "v", sampling.domain(df, "v", 4), F.rand(1), F.col("v").isNull(), "id").collect()
    assert len(drawn) == 5000 and all(r.v is not None and (r.id % 11 == 0 or r.v == r.id % 700) for r in drawn)
    empty = df.where("v is null")
    assert sampling.draw_from_domain(empty, "v", sampling.domain(empty, "v", 4), F.rand(1), F.lit(True), "id").where("v is null").count() == empty.count()


def test_uniform_baseline_draws_observed_values(spark):
    df = spark.range(2000).selectExpr("id AS unit_id", "CASE WHEN id % 3 < 2 THEN 10 * (id % 3) END AS a")
    got = {r.a: r.n for r in sampling.uniform_baseline(df, ["a"], 5, "unit_id").groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 10} and min(got.values()) > 800


def test_each_curation_rule_decides(spark):
    """For each rule a row that it alone removes."""
    good = dict(text="this is a comment with more than ten words in it, surely", author="ann", score=1, permalink="/r/a/c/b/d/")
    bad = {"B1 text": dict(text=None), "B1 link": dict(permalink=None), "B2": dict(score=None), "B3": dict(text="[deleted]"), "B4": dict(text="only nine words are in this one, nearly enough"),
           "B5": dict(author="AutoBot"), "B5 null": dict(author=None), "B6": dict(text="x" * 2100 + " a b c d e f g h i j"), "B7": dict(text="1 2 3 4 5 6 7 8 9 10 11 a b c")}
    rows = [("good", *good.values()), ("entity", "&lt; &gt; &amp; &lt; words words words words words words", "bo", 0, "/x/")]
    rows += [(k, *(good | v).values()) for k, v in bad.items()]
    df = spark.createDataFrame(rows, "name string, text string, author string, score int, permalink string")
    assert sorted(r.name for r in clean.rule_filter(df, "text", is_comment=True).collect()) == ["entity", "good"]
    # a submission has no least length; the tombstone falls to its own rule
    assert {r.name for r in clean.rule_filter(df, "text", is_comment=False).collect()} == {"good", "entity", "B4"}


def test_long_enough_counts_as_python_splits(spark):
    import random
    rnd = random.Random(2)
    texts = ["", " ", "a", "  a  b", "x" * 5000, "\u00a0a\u2003b\x1cc ", "a " * 9, "a " * 9 + "b", "a\u200bb c"] + ["".join(rnd.choice("ab \t\n\u00a0\u3000\x1f\u0085") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select("t", *[T.long_enough("t", n) for n in (0, 1, 2, 10)]).collect()]
    assert all(r[1:] == tuple(len(r[0].split()) >= n for n in (0, 1, 2, 10)) for r in got)
