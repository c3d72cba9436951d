"""Structured Streaming: exact de-duplication within a watermark, windows, and the daily micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the files of a Parquet folder."""
    return spark.readStream.schema(schema).parquet(path)


def first_within(stream: DataFrame, time: str, keys: list[str], memory: str = "7 days") -> DataFrame:
    """The first row of each key within the memory; state older than the watermark is dropped."""
    return stream.withWatermark(time, memory).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Counts and sums by window (an extension; works on streams and tables alike)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles all that has come since the last run, once, and stops; a repeated batch is handled again with its number."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
