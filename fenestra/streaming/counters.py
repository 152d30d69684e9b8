"""Counters, sessions and monitors over streams; each has the same rows as its batch form once all input is in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counters(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """hits, first_seen and last_seen by key, for update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("hits"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions by key that end after `gap` without events; what is later than `late` is dropped."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def daily_rates(events: DataFrame, at: str, bad, late: str) -> DataFrame:
    """Events and share of bad ones by day."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg(bad.cast("double")).alias("rate")).select(F.col("w.start").alias("day"), "n", "rate")


def run_available(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Runs over what is there, in micro-batches, and ends; resumes at its checkpoint."""
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
