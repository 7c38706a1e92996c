"""Event streams: counters, first and last seen, order-sensitive status, and the work queue.

Each function is a plain transformation, so it runs the same on a table and on a stream. On a stream a
watermark bounds what windows, sessions and batches keep; ``seen`` and ``status`` keep one row a user for good.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
PRECEDENCE = ("error", "view", "click", "signup", "purchase")


def seen(events: DataFrame) -> DataFrame:
    """(user_id, first_seen, last_seen, n) of each user."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def status(events: DataFrame) -> DataFrame:
    """(user_id, status, ts): the status of highest precedence, the latest of these. A later event of lower
    precedence never erases it, in whatever order events arrive."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("event_type")), F.lit(0))
    top = F.max(F.struct(rank.alias("rank"), "ts", "event_id", F.col("event_type").alias("status")))
    return events.groupBy("user_id").agg(top.alias("top")).select("user_id", "top.status", "top.ts")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) by tumbling windows of event time."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a longer pause."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def into_batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """A query that hands each micro-batch to ``work`` once what was there at the start is read; events that
    come twice count once."""
    once = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
