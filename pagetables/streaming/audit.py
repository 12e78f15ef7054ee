"""Windowed counts over an audit stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def audit_stream(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Actions and errors per tool and event-time window; rows later than `delay` are dropped once their window closed."""
    failed = F.col("status") == "error"
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(window, "tool_id")
        .agg(F.count(F.lit(1)).alias("n_actions"), F.count_if(failed).alias("n_errors"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tool_id",
                "n_actions", "n_errors")
    )


def audit_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: actions closer than `gap`."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_actions"))
        .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "user_id", "n_actions")
    )
