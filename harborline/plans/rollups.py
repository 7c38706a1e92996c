"""Rollups of postings by source and organization, in one stage and merged from two stores."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.plans.listing import _VIEW, postings
from harborline.plans.registry import query
from harborline.sources.tables import table


def _rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum((F.col("status") == "O").cast("int")).alias("active"), F.count("*").alias("total"), F.sum((F.col("status") == "P").cast("int")).alias("pending"), F.max("freshness").alias("newest"), F.max("deadline").alias("last_deadline"))


_ROLLUP = f"""SELECT source, CAST(sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS active, count(*) AS total,
 CAST(sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, max(freshness) AS newest, max(deadline) AS last_deadline
 FROM {_VIEW} GROUP BY source"""


@query("company_rollup", _ROLLUP)
def company_rollup(spark, sf_dir):
    return _rollup(postings(spark, sf_dir))


@query("company_rollup_two_stage", _ROLLUP)
def company_rollup_two_stage(spark, sf_dir):
    """Partial aggregates of the two stores, merged."""
    rows = postings(spark, sf_dir)
    parts = _rollup(rows.filter("status <> 'F'")).unionByName(_rollup(rows.filter("status = 'F'")))
    return parts.groupBy("source").agg(*(F.sum(c).alias(c) for c in ("active", "total", "pending")), *(F.max(c).alias(c) for c in ("newest", "last_deadline")))


@query("company_order", f"SELECT source, active FROM ({_ROLLUP}) ORDER BY active DESC, source")
def company_order(spark, sf_dir):
    return company_rollup(spark, sf_dir).select("source", "active").orderBy(F.desc("active"), "source")


@query("organization_rollup", f"SELECT r_name AS organization, count(*) AS total, CAST(sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS active, count(DISTINCT n_nationkey) AS members FROM {_VIEW} v JOIN nation ON nation_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def organization_rollup(spark, sf_dir):
    """Postings are counted by nation before the nations' organizations are looked up."""
    by_nation = postings(spark, sf_dir).groupBy("nation_id").agg(F.count("*").alias("total"), F.sum((F.col("status") == "O").cast("int")).alias("active"))
    groups = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by_nation.join(groups, F.col("nation_id") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("organization")).agg(F.sum("total").alias("total"), F.sum("active").alias("active"), F.count("n_nationkey").alias("members"))


@query("global_max_id", "SELECT max(o_orderkey) AS max_id FROM orders")
def global_max_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tops = [orders.filter(w).agg(F.max("o_orderkey").alias("id")) for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return tops[0].unionByName(tops[1]).agg(F.max("id").alias("max_id"))


@query("archive_partition", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'current' END AS store, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def archive_partition(spark, sf_dir):
    store = F.when(F.col("o_orderstatus") == "F", "archive").otherwise("current")
    return table(spark, sf_dir, "orders").groupBy(store.alias("store")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("cross_store_dupes", "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS stores, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 1")
def cross_store_dupes(spark, sf_dir):
    """Keys that occur in both stores."""
    orders = table(spark, sf_dir, "orders")
    store = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    keys = orders.groupBy("o_custkey").agg((F.max(store) - F.min(store) + 1).cast("long").alias("stores"), F.count("*").alias("n"))
    return keys.filter("stores > 1")


@query("histogram_by_status", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def histogram_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
