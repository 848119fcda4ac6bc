"""Streaming counterparts of the batch window operators (an addition: the batch operators see whole files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchored_pairs(anchors: DataFrame, events: DataFrame, host: str, time: str, before: str, after: str, late: str) -> DataFrame:
    """Stream-stream interval join: events of the anchor's host in [anchor - before, anchor + after]. Both sides carry
    a watermark of ``late``, so state is dropped once no partner can come."""
    a = anchors.withWatermark(time, late).select(F.col(host).alias("a_host"), F.col(time).alias("a_time"), F.col("event_id").alias("anchor_id"))
    e = events.withWatermark(time, late).select(F.col(host).alias("e_host"), F.col(time).alias("e_time"), F.col("event_id").alias("event_id"))
    near = F.expr(f"a_host = e_host AND e_time >= a_time - INTERVAL {before} AND e_time <= a_time + INTERVAL {after}")
    return a.join(e, near)


def windowed_counts(events: DataFrame, keys: list[str], time: str, width: str, late: str | None = None) -> DataFrame:
    """Events by key and tumbling window; ``late`` sets a watermark."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
