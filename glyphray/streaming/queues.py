"""Queues and nodes over time: depth, retention, retries, heartbeats, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphray.operators import history


def queue_depth(stream: DataFrame, every: str = "5 seconds", late: str = "1 minute", folder: str = "folder",
                ts: str = "ts") -> DataFrame:
    """Files per folder and time slot; the watermark lets finished slots leave the state."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("slot"), folder)
        .agg(F.count(F.lit(1)).alias("n_files"))
        .select(F.col("slot.start").alias("slot_start"), folder, "n_files")
    )


def expired(stream: DataFrame, seconds: int = 10, file: str = "file", ts: str = "ts") -> DataFrame:
    """Received files once their retention is over: a session that ends with nothing following.

    In append mode the row appears when the watermark passes arrival plus retention.
    """
    return (
        stream.withWatermark(ts, "0 seconds")
        .groupBy(file, F.session_window(ts, f"{seconds} seconds").alias("kept"))
        .agg(F.max(ts).alias("received"))
        .select(file, "received", F.col("kept.end").alias("removed_at"))
    )


def heartbeats(stream: DataFrame, gap: str, late: str = "1 minute", node: str = "node", ts: str = "ts") -> DataFrame:
    """Unbroken stretches of heartbeats per node; a new stretch means there was an outage."""
    return (
        stream.withWatermark(ts, late).groupBy(node, F.session_window(ts, gap).alias("up"))
        .agg(F.count(F.lit(1)).alias("beats"), F.max(ts).alias("last_beat"))
        .select(node, F.col("up.start").alias("first_beat"), "last_beat", "beats")
    )


def last_status(stream: DataFrame, node: str = "node", ts: str = "ts", tie: str = "event_id",
                status: str = "status") -> DataFrame:
    """Latest status per node; run in update mode."""
    return history.last_status(stream, node, ts, tie, status)
