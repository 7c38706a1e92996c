"""Incremental upkeep of the posting tables: merges, queues, delisting, counters and streaks."""
from pyspark.sql import functions as F

from harborline.operators.merge import merge
from harborline.operators.ranking import running_totals, streaks, top_per_group
from harborline.plans.listing import AS_OF
from harborline.plans.registry import query
from harborline.sources.tables import table

SINCE = "2024-01-24"


@query(
    "upsert_merge",
    """WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS note, 1 AS tries FROM orders WHERE o_orderkey % 3 <> 0),
            new AS (SELECT o_orderkey AS id, 'N' AS status, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'new' END AS note, 2 AS tries FROM orders WHERE o_orderkey % 2 = 0)
       SELECT coalesce(old.id, new.id) AS id, coalesce(new.status, old.status) AS status,
              CASE WHEN new.id IS NULL THEN old.note WHEN old.id IS NULL THEN new.note WHEN new.note = '' THEN old.note ELSE new.note END AS note,
              coalesce(old.tries, 0) + coalesce(new.tries, 0) AS tries
       FROM old FULL JOIN new ON old.id = new.id""",
)
def upsert_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    old = orders.filter("id % 3 <> 0").select("id", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"), F.lit(1).alias("tries"))
    new = orders.filter("id % 2 = 0").select("id", F.lit("N").alias("status"), F.when(F.col("id") % 4 == 0, "").otherwise("new").alias("note"), F.lit(2).alias("tries"))
    return merge(old, new, "id", {"status": "replace", "note": "keep_if_blank", "tries": "increment"})


@query("orphan_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orphan_anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_in(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("delist_missing", f"SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '{AS_OF}') THEN 1 ELSE 0 END AS is_active FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
def delist_missing(spark, sf_dir):
    """Open postings of one source, inactive where the latest run didn't touch them; other sources stay out."""
    touched = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit(AS_OF)).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(1))
    source = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    mine = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(source, "o_custkey", "left_semi")
    return mine.join(touched, "o_orderkey", "left").select("o_orderkey", F.coalesce("seen", F.lit(0)).alias("is_active"))


@query(
    "queue_with_retry",
    f"""WITH failed AS (SELECT user_id, count(*) AS attempts, max(ts) AS last_failed FROM events WHERE event_type = 'error' GROUP BY user_id),
             seen AS (SELECT user_id, max(ts) AS scraped FROM events WHERE event_type = 'view' GROUP BY user_id)
        SELECT s.user_id, scraped, coalesce(attempts, 0) AS attempts FROM seen s LEFT JOIN failed f ON s.user_id = f.user_id
        WHERE f.user_id IS NULL OR attempts < 2 OR (scraped > last_failed AND scraped >= TIMESTAMP '{SINCE}')""",
)
def queue_with_retry(spark, sf_dir):
    """Captures to work on: fewer than two failures, or captured anew since the last one."""
    events = table(spark, sf_dir, "events")
    latest = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("scraped"), F.sum((F.col("event_type") == "error").cast("int")).alias("attempts"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_failed"))
    again = (F.col("scraped") > F.col("last_failed")) & (F.col("scraped") >= F.lit(SINCE))
    return latest.filter(F.col("scraped").isNotNull() & ((F.col("attempts") < 2) | again)).select("user_id", "scraped", "attempts")


@query("failure_counter", "SELECT user_id, count(*) AS attempt_count, max(ts) AS last_failed_at, arg_max(event_id, (ts, event_id)) AS last_event FROM events WHERE event_type = 'error' GROUP BY user_id")
def failure_counter(spark, sf_dir):
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return errors.groupBy("user_id").agg(F.count("*").alias("attempt_count"), F.max("ts").alias("last_failed_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("click_counts", "SELECT user_id, count(*) AS clicks, max(ts) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id")
def click_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_click"))


@query("toggle_parity", "SELECT user_id, CAST(count(*) % 2 AS INTEGER) AS is_saved FROM events WHERE event_type = 'click' GROUP BY user_id")
def toggle_parity(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy("user_id").agg((F.count("*") % 2).cast("int").alias("is_saved"))


@query(
    "success_streak",
    """SELECT user_id, event_id, CAST(CASE WHEN event_type <> 'error' THEN count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) ELSE 0 END AS BIGINT) AS streak
       FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)""",
)
def success_streak(spark, sf_dir):
    return streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "streak")


@query("first_last_seen", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN max(ts) >= TIMESTAMP '2024-01-24' THEN 1 ELSE 0 END AS touched FROM events GROUP BY user_id")
def first_last_seen(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.when(F.max("ts") >= F.lit(SINCE), 1).otherwise(0).alias("touched"))


@query("status_merge", "SELECT user_id, event_type AS status, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 0 ELSE 1 END DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def status_merge(spark, sf_dir):
    """The status of highest precedence, and the latest of these: a later capture doesn't erase a known one."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("rank", rank)
    return top_per_group(rows, ["user_id"], [F.desc("rank"), F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("status"), "ts")


@query("recently_viewed", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31') WHERE rn <= 20")
def recently_viewed(spark, sf_dir):
    views = table(spark, sf_dir, "events").filter("event_type = 'view' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'")
    return top_per_group(views, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "ts")


@query("identity_allocation", "SELECT event_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id) AS public_id FROM events WHERE event_type = 'signup'")
def identity_allocation(spark, sf_dir):
    """New ids after the largest known one, in key order."""
    new = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", F.lit(1).alias("one"))
    top = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    return running_totals(new, "event_id", "one", "place").select("event_id", (top + F.col("place")).alias("public_id"))


@query("requeue_stale", "SELECT c_mktsegment AS source, count(*) AS stale FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY stale DESC, source")
def requeue_stale(spark, sf_dir):
    old = table(spark, sf_dir, "orders").filter("o_orderdate < TIMESTAMP '1996-01-01'")
    customer = table(spark, sf_dir, "customer")
    return old.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("source")).agg(F.count("*").alias("stale")).orderBy(F.desc("stale"), "source")
