"""Sharding by jump consistent hashing: a stable key and the shard count name the shard.

No ring table is kept.  With one more shard, a key either stays or goes to the new shard,
so about 1 in (shards + 1) rows move, and none between old shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import map_arrow, read

SHARDS = 40
#: A shard's rows are numbered in so many buckets of a key hash, each on its own.
BUCKETS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once: every key jumps on until it passes ``shards``."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def shard_by_key(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Shard every row by its doc_id; number each shard's rows without gaps.

    ``size`` is the text's UTF-8 bytes plus 16.  A NULL text has size 16 and the CRC of
    nothing; rows with a NULL doc_id share one key; equal rows share a shard and get slots
    of their own; an empty table gives an empty one.

    The text is read in the scan only.  A shard is never one sort: rows are numbered inside
    (shard, bucket) and moved on by the rows of the shard's earlier buckets, a table of
    shards x buckets counts, which is what is broadcast."""
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 16).alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
                       hashed.alias("hashed"))

    def place(batches):
        for b in batches:
            keys = b.column("hashed").to_numpy(zero_copy_only=False).view(np.uint64)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array(jump_hash(keys, shards).astype(np.int32)), pa.array(jump_hash(keys, shards + 1).astype(np.int32)),
                     pa.array((keys % np.uint64(buckets)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket"])

    kind = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, bucket int"
    rows = map_arrow(slim, place, kind)
    # counts need the keys only: this scan reads doc_id alone
    keys = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"),
                                 F.lit(0).cast("long").alias("text_crc32"), hashed.alias("hashed")), place, kind)
    counts = keys.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("at", F.row_number().over(order) - 1)
            .join(F.broadcast(starts), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("at") + F.col("start")).cast("long").alias("slot"), "grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_key(read(spark, sf_dir, "documents"))
