"""Incremental ingest: chunk files as a stream, each chunk once, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import PointStore


def chunk_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New *.chunks.jsonl files under path; an id is let through once within the state's horizon."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.chunks.jsonl").option("maxFilesPerTrigger", per_trigger).json(path)
    return raw.where(F.col("chunk_id").isNotNull()).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["chunk_id"]).drop("seen_at")


def upsert_stream(chunks: DataFrame, store: PointStore, model: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Encodes and stores each micro-batch's missing chunks; a batch that is replayed adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        todo = store.missing(df).drop("point_id")
        if not todo.isEmpty():
            store.upsert(encode(todo), model)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; state of windows past the watermark is dropped. Works on streams and tables."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )
