"""Ticks to bars as a stream: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import tick_columns


def read_ticks(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """Tick stream of a folder; the glob picks one table where several share it."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return raw.select(*tick_columns()).where(F.col("price") > 0)


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """One bar per symbol and window; rows older than the watermark are dropped and counted by Spark."""
    at = F.col("event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
