"""Learned-baseline queries (L1-L5).  The fits are iterative, so the search has no SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.draws import sql_uniform, uniform
from causeway.operators import baseline as BL
from causeway.plans import tables as TB
from causeway.plans.registry import register

TRAIN_SHARE = 0.8

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')"
BOW_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
v AS (SELECT DISTINCT term FROM t JOIN labels USING (doc_id) WHERE {sql_uniform(0, 'split', 'doc_id')} < {TRAIN_SHARE}),
c AS (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_distinct FROM t JOIN v USING (term) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(n_distinct, 0) AS BIGINT) AS n_distinct
FROM documents d LEFT JOIN c USING (doc_id)
"""


@register("bow_documents", BOW_SQL)
def bow_documents(spark, sf):
    """Bag-of-words counts; vocabulary of the labelled training split, every term of
    it, applied to every document."""
    docs = TB.table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(TB.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    vocab = BL.vocabulary(labelled.where(uniform(0, "split", "doc_id") < TRAIN_SHARE), "text")
    counts = BL.bag_of_words(docs, vocab, "doc_id", "text").groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce("k", F.lit(0)).cast("bigint").alias("n_distinct"))


FIELDS = ("label", "label_high")


def _split_embeddings(spark, sf):
    e = TB.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<float>").alias("features"), F.col("label").cast("string").alias("label"),
        (F.col("label") >= 5).cast("int").cast("string").alias("label_high"))
    train = uniform(0, "split", "vec_id") < TRAIN_SHARE
    return e.where(train), e.where(~train)


@register("baseline_search_embeddings")
def baseline_search_embeddings(spark, sf):
    """L4: all 144 published settings, mean accuracy of three folds per field and setting."""
    train, _ = _split_embeddings(spark, sf)
    search = BL.grid_search(train, "vec_id", "features", FIELDS, folds=3)
    return search.groupBy("field", "setting", *BL.GRID).agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))


@register("text_baseline_embeddings")
def text_baseline_embeddings(spark, sf):
    """L2 + L3 + L4 + L5: per field (label, upper half of the label range) a perceptron searched
    over all 144 published settings, refitted, and scored on train and val."""
    train, val = _split_embeddings(spark, sf)
    best = BL.best_settings(BL.grid_search(train, "vec_id", "features", FIELDS, folds=3))
    models = BL.fit_fields(train, "vec_id", "features", best)
    acc = [BL.field_accuracy(BL.predict_fields(models, part, "features"), FIELDS, name) for name, part in (("train", train), ("val", val))]
    return acc[0].unionByName(acc[1]).select("field", "split", F.round("acc", 6).alias("acc"))
