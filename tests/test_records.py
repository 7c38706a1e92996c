import datetime as dt
import json
import random

from harborline.streaming import events as E
from harborline.streaming.records import record_stream, records

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def _run(spark, rows, folder, name):
    """The records of a stream that reads ``rows`` list by list, and the state rows after each batch."""
    path = str(folder)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, E.EVENTS).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = record_stream(source, HOUR, HOUR).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p.stateOperators]
    return sorted(map(tuple, spark.table(name).collect())), kept


def test_stream_equals_table_and_state_goes(spark, tmp_path):
    r = random.Random(1)
    rows, at = [], START
    for i in range(160):
        at += dt.timedelta(minutes=r.choice([1, 3, 10, 45]))
        rows.append((i, at, i % 5 if i < 120 else 9, r.choice([*E.PRECEDENCE, None]), 1.0, "{}"))
    end = (999, at + 9 * HOUR, 77, "view", 1.0, "{}")  # moves the watermark past all others
    parts = [rows[k : k + 40] for k in range(0, 160, 40)]
    for p in parts:
        r.shuffle(p)
    got, kept = _run(spark, [*parts, [end]], tmp_path / "events", "records_in_order")
    want = sorted(map(tuple, records(spark.createDataFrame(rows, E.EVENTS), HOUR).collect()))
    assert got == want and len(want) > 5
    assert max(kept) >= 5 and kept[-1] == 1  # only the last event's user is left


def test_nulls_ties_and_empty_tables(spark):
    rows = [(2, START, 1, "view", 0.0, None), (1, START, 1, "error", 0.0, None), (3, START, None, "view", 0.0, None), (4, None, 1, "view", 0.0, None), (5, START + HOUR, 1, None, 0.0, None), (6, START + 3 * HOUR, 1, "purchase", 0.0, None)]
    got = sorted(map(tuple, records(spark.createDataFrame(rows, E.EVENTS), HOUR).collect()))
    assert got == [(1, START, START + HOUR, 3, "view", 2), (1, START + 3 * HOUR, START + 3 * HOUR, 1, "purchase", 1)]
    assert records(spark.createDataFrame([], E.EVENTS)).count() == 0
