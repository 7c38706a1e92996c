"""Orders that are finished move with their lines from the current to the archive store."""
import tempfile
import uuid

from pyspark.sql import functions as F

from harborline.operators.archive import Table, move_postings
from harborline.plans.registry import query
from harborline.sources.tables import table

TABLES = [Table("orders", "o_orderkey", "o_orderkey", (("o_orderstatus", "'A'"),)), Table("lineitem", "line", "l_orderkey")]


def _folder(spark) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or under a local master a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='harborline-')}"
    return f"{at.rstrip('/')}/stores-{uuid.uuid4().hex}"


@query(
    "archived_orders",
    """WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders)
       SELECT CASE WHEN done THEN 'archive' ELSE 'current' END AS store, 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY done
       UNION ALL SELECT CASE WHEN coalesce(done, FALSE) THEN 'archive' ELSE 'current' END, 'lineitem', count(*), CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY coalesce(done, FALSE)""",
)
def archived_orders(spark, sf_dir):
    """Rows and keys of both stores after the move."""
    at = _folder(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.parquet(f"{at}/current/orders")
    table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey", "l_quantity").write.parquet(f"{at}/current/lineitem")
    move_postings(spark, orders.filter("o_orderstatus = 'F'").select("o_orderkey"), f"{at}/current", f"{at}/archive", TABLES, f"{at}/manifest")
    parts = [spark.read.parquet(f"{at}/{store}/{t.name}").agg(F.count("*").alias("n"), F.sum(t.key).alias("keys")).select(F.lit(store).alias("store"), F.lit(t.name).alias("name"), "n", "keys") for store in ("current", "archive") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")
