"""Every query with SQL against DuckDB on the smallest tables."""
import datetime as dt
import os

import duckdb
import pytest

from harborline.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    mine = sorted(([plain(r[c]) for c in order] for r in got.collect()), key=key)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in want.fetchall()), key=key)
    assert mine == theirs


def test_quotas_cover_all_sources(spark):
    rows = QUERIES["source_quota"](spark, DATA).collect()
    assert all(1 <= r["quota"] <= r["n"] for r in rows)


def test_entry_has_all_queries(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["source", "posting_id", "freshness"]
