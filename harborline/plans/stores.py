"""Queries over the current and the archive store, the two halves of orders by status."""
from pyspark.sql import functions as F

from harborline.operators import stores
from harborline.plans.registry import query
from harborline.sources.tables import table


@query(
    "archive_move",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') THEN 'archive' ELSE 'current' END AS store FROM orders",
)
def archive_move(spark, sf_dir):
    """Open postings that expired go to the archive; everything else stays where it is."""
    orders = table(spark, sf_dir, "orders")
    current, archive = orders.filter("o_orderstatus <> 'F'"), orders.filter("o_orderstatus = 'F'")
    expired = current.filter("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'")
    left, right = stores.move(current, archive, expired, "o_orderkey")
    return left.select("o_orderkey", F.lit("current").alias("store")).unionByName(right.select("o_orderkey", F.lit("archive").alias("store")))


@query(
    "parity_report",
    """SELECT state, count(*) AS n FROM (
         SELECT CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey IS NULL THEN 'only_right' WHEN a.o_orderpriority = b.o_orderpriority AND a.o_custkey = b.o_custkey THEN 'same' ELSE 'changed' END AS state
         FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) a
         FULL JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0) b ON a.o_orderkey = b.o_orderkey)
       GROUP BY state""",
)
def parity_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    other = orders.filter("o_orderkey % 3 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderpriority")))
    return stores.parity(orders.filter("o_orderkey % 5 <> 0"), other, "o_orderkey", ["o_custkey", "o_orderpriority"]).groupBy("state").agg(F.count("*").alias("n"))


@query("fill_if_empty", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS note FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fill_if_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("note"))
    return stores.fill_if_empty(docs, docs.select("doc_id", F.lit("unknown").alias("note")), "doc_id", "note")


@query("correction_diff", "SELECT o_orderkey, o_orderpriority AS before, substr(o_orderpriority, 1, 1) || ' ' || lower(substr(o_orderpriority, 3)) AS after FROM orders WHERE o_orderstatus = 'P'")
def correction_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    new = old.withColumn("o_orderpriority", F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" "), F.lower(F.expr("substring(o_orderpriority, 3)"))))
    return stores.changes(old, new, "o_orderkey", "o_orderpriority")


@query("bounded_archive_plan", "SELECT doc_id, CAST(running_bytes AS BIGINT) AS running_bytes FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS running_bytes FROM documents) WHERE running_bytes <= 500000")
def bounded_archive_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stores.bounded_plan(docs, "doc_id", F.octet_length("text").cast("long"), 500_000).select("doc_id", "running_bytes")
