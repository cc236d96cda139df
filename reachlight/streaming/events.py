"""Windowed counts of an event stream with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counted(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of (ts, event_type, value) by window; works on streams and tables alike."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
