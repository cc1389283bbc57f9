"""The pipeline's stages against brute force, and the whole run on the small table."""

import random

import corpus_pipeline as cp
from test_jaccard_join import brute as brute_components
from test_packing import check_pieces
from test_quality_rules import OTHER

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_of_each_group(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(200)]
    docs = [(i, " ".join([*base[:i % 5], *base])) for i in range(20)] + [(50, "a b c d"), (51, "A B C D"), (51, "A B C D"), (60, ""), (61, None)]
    docs += [(None, "a b c d"), (None, "x y z"), (None, "x y z"), (70, "p q r"), (70, "s t u")]
    df = spark.createDataFrame([(i, t, "en", None, 3) for i, t in docs], KIND).repartition(3)
    got = cp.keep_one_of_each_group(spark, df, None)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r["text"]) for r in got.collect() if r.doc_id is not None) == \
        sorted((str(i), t) for i, t in {(0, docs[0][1]), (50, "a b c d"), (60, ""), (61, None), (70, "p q r"), (70, "s t u")})
    assert sorted(r["text"] for r in got.collect() if r.doc_id is None) == ["x y z"]


def test_clashing_columns_stay(spark):
    text = OTHER["it"]
    df = spark.createDataFrame([(1, text, "r", "v", "k", 5)], "doc_id long, text string, rules string, _verdict string, _key string, _row int")
    for stage in (cp.keep_ruled, cp.keep_one_of_each_group):
        assert [tuple(r) for r in stage(spark, df, None).collect()] == [(1, text, "r", "v", "k", 5)]


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a = cp.keep_scored(spark, docs, sf_dir)
    b = cp.keep_ruled(spark, a, sf_dir)
    c = cp.keep_one_of_each_group(spark, b, sf_dir)
    assert a.columns == b.columns == c.columns == docs.columns
    left = {r.doc_id: r["text"] for r in b.collect()}
    groups = {d: g for _, d, _, g in brute_components(list(left.items()))}
    kept = {r.doc_id: r["text"] for r in c.collect()}
    assert kept == {d: t for d, t in left.items() if groups[d] == d}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & set(kept)) <= 0.1 * len(bad)
    check_pieces(cp.run(spark, sf_dir).collect(), list(kept.items()))
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]


def test_empty(spark, sf_dir):
    none = spark.createDataFrame([], KIND)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
