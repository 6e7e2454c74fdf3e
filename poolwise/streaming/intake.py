"""Stateless pool intake on a stream of manifest files.

The reference has no streaming (SURVEY §2.I); new generated items arrive as
JSON-lines files. This runs the same stateless pool operators (B1 filter with
a stream-static anti join on seed ids, B3 label encoding) on ``readStream``
and writes each micro-batch idempotently: a replayed batch overwrites its own
partition instead of appending duplicates. No state, no watermark needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import REAL_VALUES, encode_label, seed_id
from ..schemas import MANIFEST


def pool_stream(spark: SparkSession, manifest_dir: str, exclude_seed_ids: DataFrame | None = None,
                dataset: str = "fakett", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of new pool items: video_id, y, source, seed_id. A
    malformed line, or one without an id, never becomes an item."""
    reader = spark.readStream.schema(MANIFEST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    items = reader.json(manifest_dir)
    pool = (items.filter(F.col("video_id").isNotNull() & ~F.col("source").eqNullSafe(F.lit("Human")))
            .withColumn("seed_id", seed_id("video_id")))
    if exclude_seed_ids is not None:
        seeds = exclude_seed_ids.select(F.col(exclude_seed_ids.columns[0]).alias("seed_id")).distinct()
        pool = pool.join(seeds, "seed_id", "left_anti")  # stream-static anti join
    return pool.select("video_id", encode_label("label", REAL_VALUES[dataset]).alias("y"), "source", "seed_id")


def write_pool_stream(stream: DataFrame, out_path: str, checkpoint_location: str,
                      available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch as partition ``batch=<id>`` with dynamic
    partition overwrite (a batch replayed after a failure replaces itself)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
