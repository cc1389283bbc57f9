"""Curation rules on a streaming source.

The reference has no streaming semantics (no watermark, window or state); what
carries over is that the curation filters (B1-B9) and term matching (B10/B11)
are stateless column logic, so the same expressions run unchanged on
``readStream``.  Output is appended by ``foreachBatch`` into the committed stage
table, skipping units already present (the batch counterpart of resume, A8),
with the query checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import clean
from causeway.sources.io import CORRUPT, committed


def curated_stream(spark: SparkSession, path: str, schema, text: str, is_comment: bool, terms=(),
                   cutoff: int | None = None, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming archive scan -> date cutoff -> rule filter -> optional term match."""
    s = (spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", max_files_per_trigger)
         .json(path))
    if CORRUPT in s.columns:
        s = s.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if cutoff is not None:
        s = clean.date_cutoff(s, "created_utc", cutoff)
    s = clean.rule_filter(s, text, is_comment)
    if terms:
        fields = [c for c in ("subreddit", "title", text, "initial_post") if c in s.columns]
        s = clean.mention_filter(s, fields, terms, "treatments")
    return s


def append_new(out_path: str, key: str):
    """foreachBatch sink: append one row of each key that is not in the committed table yet
    (idempotent if a micro-batch is replayed after a failure).  A table that cannot be
    read is an error, not an empty one."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key])
        if committed(spark, out_path):
            batch = batch.join(spark.read.parquet(out_path).select(key), key, "left_anti")
        batch.write.mode("append").parquet(out_path)
    return write


def start_curation(stream: DataFrame, out_path: str, checkpoint: str, key: str = "permalink", once: bool = True):
    w = stream.writeStream.foreachBatch(append_new(out_path, key)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
