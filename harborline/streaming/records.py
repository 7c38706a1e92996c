"""Activity records of users: first and last seen, count, status by precedence, and the streak since the last error.

A record ends when its user has been quiet for a while. ``records`` makes them from a table; ``record_stream``
makes the same ones from a stream, whose state goes when a record is written. Nothing is kept of a quiet user.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harborline.streaming.events import PRECEDENCE

BAD = "error"
QUIET, LATE = dt.timedelta(hours=6), dt.timedelta(hours=1)
RECORD = "user_id long, first_us long, last_us long, n long, status string, streak long"
# A record so far, and the events behind the watermark's place that can still be overtaken.
STATE = "first_us long, last_us long, n long, rank int, rank_us long, rank_id long, status string, streak long, us array<long>, ids array<long>, kinds array<string>"


def _rank(kind: str | None) -> int:
    return PRECEDENCE.index(kind) + 1 if kind in PRECEDENCE else 0


def _begun(us: int) -> list:
    return [us, us, 0, -1, us, 0, None, 0]


def _with(record: list, us: int, event: int, kind: str | None) -> list:
    """``record`` after its next event in time."""
    first, _, n, *top, streak = record
    mine = [_rank(kind), us, event, kind]
    return [first, us, n + 1, *(mine if mine[:3] > top[:3] else top), 0 if kind == BAD else streak + 1]


def _advance(quiet_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record, waiting = None, []
        if state.exists:
            *record, us, ids, kinds = state.get
            record = None if record[0] is None else record
            waiting = list(zip(us, ids, kinds))
        for b in batches:
            waiting += zip(b["us"].tolist(), b["event_id"].tolist(), [x if isinstance(x, str) else None for x in b["event_type"]])
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda e: e[:2])
        settled = len(waiting) if state.hasTimedOut else sum(e[0] < mark for e in waiting)
        done = []
        for us, event, kind in waiting[:settled]:
            if record is not None and us - record[1] > quiet_us:
                done.append(record)
                record = None
            record = _with(record or _begun(us), us, event, kind)
        waiting = waiting[settled:]
        if record is not None and not waiting and record[1] + quiet_us < mark:
            done.append(record)
            record = None
        if record is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((*(record or [None] * 8), *map(list, zip(*waiting))) if waiting else (*record, [], [], []))
            last = waiting[-1][0] if waiting else record[1]
            state.setTimeoutTimestamp(max((last + quiet_us) // 1000, mark // 1000 + 1))
        if done:
            yield pd.DataFrame([(key[0], r[0], r[1], r[2], r[6], r[7]) for r in done], columns=["user_id", "first_us", "last_us", "n", "status", "streak"])

    return run


def _shown(df: DataFrame, events: DataFrame) -> DataFrame:
    at = lambda c: F.timestamp_micros(c).cast(events.schema["ts"].dataType)
    return df.select("user_id", at("first_us").alias("first_seen"), at("last_us").alias("last_seen"), "n", "status", "streak")


def record_stream(events: DataFrame, quiet: dt.timedelta = QUIET, late: dt.timedelta = LATE) -> DataFrame:
    """(user_id, first_seen, last_seen, n, status, streak) of each record that ended, in append mode.

    Events may come in any order within ``late``; later ones are left out. A user's events wait until the watermark
    has passed them, so the order of arrival changes nothing; what has been passed is one record of fixed size.
    A record ends with a pause longer than ``quiet``, and then its state goes. Events without a user
    or a time belong to no record.
    """
    micros = lambda d: d // dt.timedelta(microseconds=1)
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{micros(late)} microseconds")
    rows = rows.select("user_id", "event_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ended = rows.groupBy("user_id").applyInPandasWithState(_advance(micros(quiet)), RECORD, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _shown(ended, events)


def records(events: DataFrame, quiet: dt.timedelta = QUIET) -> DataFrame:
    """The same of a table, where every record counts as ended."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    begins = F.coalesce(F.col("us") - F.lag("us").over(order) > quiet // dt.timedelta(microseconds=1), F.lit(False))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("record", F.sum("begins").over(order)).withColumn("place", F.row_number().over(order))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("event_type")), F.lit(0))
    top = F.max(F.struct(rank.alias("rank"), "us", "event_id", F.col("event_type").alias("status")))
    last_bad = F.coalesce(F.max(F.when(F.col("event_type") == BAD, F.col("place"))), F.min("place") - 1)
    out = rows.groupBy("user_id", "record").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), top["status"].alias("status"), (F.max("place") - last_bad).cast("long").alias("streak"))
    return _shown(out, events)
