"""Event-time windows over events (user_id, event_type, ts, value), the same expressions on batches and streams.

Starts are timestamps without time zone, so results don't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay else events


def tumbling(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    rows = _late(events, delay).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n", "value")


def sliding(events: DataFrame, width: str, step: str, delay: str | None = None) -> DataFrame:
    rows = _late(events, delay).groupBy("event_type", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    rows = _late(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of events with one id, among those that come within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
