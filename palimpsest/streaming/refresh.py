"""Streams over the usage log and over arriving commits, equal to their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usage_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Calls by window and command; in a stream, windows close once the watermark has passed."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    counted = stamped.groupBy(F.window("at", window), F.col("event_type").alias("command")).agg(F.count("*").alias("calls"), F.sum("value").alias("elapsed"))
    return counted.select(F.col("window.start").alias("start"), "command", "calls", "elapsed")


def followups(events: DataFrame, origin: str, follower: str, *, seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Pairs of an origin and a follower of one user within ``seconds``: an interval join of two streams with watermarks."""
    def side(kind: str, name: str) -> DataFrame:
        s = events.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").cast("timestamp").alias(f"{name}_at"))
        return s.withWatermark(f"{name}_at", late) if events.isStreaming else s

    a, b = side(origin, "origin"), side(follower, "follower")
    within = (F.col("origin_user") == F.col("follower_user")) & (F.col("follower_at") >= F.col("origin_at")) & (F.col("follower_at") <= F.col("origin_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, within).select(F.col("origin_user").alias("user_id"), "origin_id", "follower_id")


def refresh(spark: SparkSession, source: str, schema, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch of files that have arrived in ``source`` to ``apply`` once, and stop when none are left."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
