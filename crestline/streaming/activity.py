"""Windowed activity counts, the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value per window and kind; on a stream, later than `late` is too late."""
    held = events.withWatermark("created_at", late) if events.isStreaming else events
    out = held.groupBy(F.window("created_at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), "kind", "n", F.bround("value", 4).alias("value"))


def read_activity_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files of events as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_once(batch: DataFrame, known: DataFrame) -> DataFrame:
    """What a micro-batch adds: the first row of each content id that is not known yet."""
    fresh = batch.withColumn("external_id", F.concat(F.lit("u_"), F.substring(F.sha2(F.col("content"), 256), 1, 14)))
    return fresh.dropDuplicates(["external_id"]).join(known.select("external_id"), "external_id", "left_anti")
