"""The corpus pipeline: four stages over ``documents``, each written as Parquet and read again.

The quality classifier and the quality rules drop the documents they reject, the Jaccard
join keeps one document of each group of linked ones, and what is left is packed into
sequences.  Every stage but the last returns the columns it got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import read
from causeway.llm.jaccard_join import link_components
from causeway.llm.packing import pack
from causeway.llm.quality_model import keep_accepted
from causeway.llm.quality_rules import score_rules
from causeway.session import checkpoint_dir


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a NULL text is scored as an empty one."""
    return keep_accepted(docs, read(spark, sf_dir, "labels"))


def keep_ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  A NULL or empty text has no words: it goes."""
    verdict = _free("_verdict", docs)
    return score_rules(docs, out=verdict).where(f"`{verdict}`.kept").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least doc_id (a row without one
    comes last), of several with that doc_id the one of the least key.

    Rows are told apart by a key, a hash of doc_id and text, so rows that share a doc_id but
    not a text are documents of their own, and rows without a doc_id take part.  Rows that
    repeat another in both are one document, of which one row stays; a NULL, empty or wordless
    text links with nothing and stays."""
    key, row = _free("_key", docs), _free("_row", docs)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull()))
    linked = link_components(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("k"), F.col("component_id").alias("c"))
    named = keyed.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("d")).groupBy("k").agg(F.min("d").alias("d"))
    order = F.struct(F.col("d").isNull(), "d", "k")
    first = linked.distinct().join(named, "k").groupBy("c").agg(F.min(order).alias("first")).select(F.col("first.k").alias(key))
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy(key).orderBy(*others, F.col(key))
    kept = keyed.join(first, key, "left_semi").withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return kept.select(*docs.columns)


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 ids.

    Executors come to this stage with their heaps full, so the chunk cache is kept small."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=50_000)


STAGES = [("quality classifier", keep_scored), ("quality rules", keep_ruled), ("n-gram Jaccard join", keep_one_of_each_group),
          ("packing", pack_kept)]

#: A trained classifier, a similarity join with components and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows go through the shared folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus_pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
