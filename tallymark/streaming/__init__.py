"""Structured Streaming on event tables: an extension, the batch operators need none of it.

Every aggregation carries a watermark, so state is dropped once its window can get no more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files; timestamps without zone become instants."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed(events: DataFrame, time_col: str, keys: list[str], window: str, slide: str | None = None, late: str = "1 hour", value_col: str | None = None) -> DataFrame:
    """Counts (and sums) per tumbling or sliding window and key; rows later than ``late`` are dropped."""
    aggregates = [F.count("*").alias("n")] + ([F.sum(value_col).alias("total")] if value_col else [])
    timed = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    spans = F.window("__t", window, slide) if slide else F.window("__t", window)
    by = timed.groupBy(spans.alias("w"), *keys).agg(*aggregates)
    return by.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in by.columns if c not in ("w", *keys)])


def sessions(events: DataFrame, time_col: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key: rows closer than ``gap`` belong together."""
    timed = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    by = timed.groupBy(F.session_window("__t", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return by.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, id_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([id_col]).drop("__t")


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet files, once, resuming from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
