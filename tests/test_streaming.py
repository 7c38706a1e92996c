import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.functions import durations
from harborline.streaming import events as stream
from tests.test_functions import value


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=7 * i), i % 5, stream.PRECEDENCE[i % 4 if i % 3 else 4], float(i), "{}") for i in range(60)]
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], stream.EVENTS).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("f, mode", [(stream.seen, "complete"), (stream.status, "complete"), (stream.windowed_counts, "complete"), (stream.sessions, "complete")])
def test_stream_equals_table(spark, table, f, mode):
    want = sorted(map(tuple, f(spark.read.parquet(table)).collect()))
    name = f"out_{f.__name__}"
    source = spark.readStream.schema(stream.EVENTS).option("maxFilesPerTrigger", 1).parquet(table)
    f(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == want and want


def test_batches_count_repeated_events_once(spark, table, tmp_path):
    out = str(tmp_path / "out")
    twice = spark.readStream.schema(stream.EVENTS).parquet(table)
    twice = twice.union(twice)
    stream.into_batches(twice, str(tmp_path / "checkpoint"), lambda batch, _: batch.write.mode("append").parquet(out)).awaitTermination(120)
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select(F.countDistinct("event_id")).first()[0] == 60


@pytest.mark.parametrize("given, want", [("Indeterminate", "Permanent"), ("up to 3 years", "Up to 3 years"), ("May - August 2027", "2027-05-01 to 2027-08-31"), ("Sept 5, 2026 to Dec 20, 2026", "2026-09-05 to 2026-12-20"), ("13/01/2026 - 02/02/2026", "2026-01-13 to 2026-02-02"), ("10 month work year", "10-month work year"), ("Fall 2026 semester", "Fall 2026"), ("Contract full-time", "Term"), ("Job end date: 2026-08-31", "Term ending 2026-08-31"), ("1 yr", "1 year"), ("mai 2026 to août 2026", "2026-05-01 to 2026-08-31"), ("N/A", ""), (None, ""), ("Ongoing", "Ongoing"), ("Seasonal", "Seasonal"), ("competitive pay", "")])
def test_duration(spark, given, want):
    got = value(spark, durations.duration, given)
    assert got == want and value(spark, durations.duration, got) == got
