"""Publishing, retiring and restoring postings, guarded corrections with their log, and checks of single values."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import posting_checks as C
from harborline.operators import stores
from harborline.operators.ranking import streaks, top_per_group
from harborline.plans.posting_fields import _CAPTURES, captures
from harborline.plans.registry import query
from harborline.sources.tables import table

RUN = "2024-01-24"
_BARE = "NOT parsed AND length(raw_text) < 400"


@query("publish_metadata_only", f"SELECT posting_id, CASE WHEN {_BARE} THEN '' ELSE md5(raw_text) END AS text_md5, CASE WHEN {_BARE} THEN '{RUN}' END AS parsed_at FROM {_CAPTURES}")
def publish_metadata_only(spark, sf_dir):
    """Captures without enough text for details are published as they are: marked as parsed, their text blanked."""
    bare = ~F.col("parsed") & (F.length("raw_text") < 400)
    return captures(spark, sf_dir).select("posting_id", F.when(bare, "").otherwise(F.md5("raw_text")).alias("text_md5"), F.when(bare, RUN).alias("parsed_at"))


@query("promote_pending", f"SELECT posting_id, CASE WHEN parsed THEN 'details' ELSE 'shell' END AS kind FROM {_CAPTURES} WHERE parsed OR coalesce(pending_status, '') <> 'blocked'")
def promote_pending(spark, sf_dir):
    """Details, and shells of pending captures that have none; blocked ones wait."""
    rows = captures(spark, sf_dir)
    details = rows.filter("parsed").select("posting_id", F.lit("details").alias("kind"))
    pending = rows.filter("coalesce(pending_status, '') <> 'blocked'").select("posting_id", F.lit("shell").alias("kind"))
    return details.unionByName(pending.join(details, "posting_id", "left_anti"))


@query(
    "retire_postings",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 ELSE 1 END AS is_active, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'gone' END AS reason,
       (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1995-01-01') AS kept_lines FROM orders""",
)
def retire_postings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lit(1).alias("is_active"), F.lit(None).cast("string").alias("reason"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    store, left = stores.retire(orders, {"lines": lines}, orders.filter("o_orderdate < TIMESTAMP '1995-01-01'"), "o_orderkey", "gone")
    kept = left["lines"].groupBy("o_orderkey").agg(F.count("*").alias("kept_lines"))
    return store.join(kept, "o_orderkey", "left").select("o_orderkey", "is_active", "reason", F.coalesce("kept_lines", F.lit(0)).alias("kept_lines"))


@query("archive_restore", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'archive' ELSE 'current' END AS store FROM orders")
def archive_restore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    archive, current = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'")
    left, back = stores.restore(archive, current, archive.filter("o_orderdate >= TIMESTAMP '1995-01-01'"), "o_orderkey")
    return left.select("o_orderkey", F.lit("archive").alias("store")).unionByName(back.select("o_orderkey", F.lit("current").alias("store")))


def _wanted(orders: DataFrame) -> DataFrame:
    """A correction that was planned when every seventh order had another priority."""
    before = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.col("o_orderpriority"))
    return orders.filter("o_orderstatus = 'P'").select("o_orderkey", before.alias("before"), F.concat(F.lit("P:"), F.col("o_orderpriority")).alias("after"))


@query("guarded_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN 'P:' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority FROM orders")
def guarded_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return stores.guarded_update(orders, _wanted(orders), "o_orderkey", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("guarded_update_misses", "SELECT count(*) AS misses FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0")
def guarded_update_misses(spark, sf_dir):
    """What the guard held back, counted after the update."""
    orders = table(spark, sf_dir, "orders")
    wanted = _wanted(orders)
    return stores.not_applied(stores.guarded_update(orders, wanted, "o_orderkey", "o_orderpriority"), wanted, "o_orderkey", "o_orderpriority").agg(F.count("*").alias("misses"))


@query("audit_log", "SELECT o_orderkey, 'priority' AS field, CAST(json_object('before', CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderpriority END, 'after', 'P:' || o_orderpriority) AS VARCHAR) AS entry FROM orders WHERE o_orderstatus = 'P'")
def audit_log(spark, sf_dir):
    return stores.audit_log(_wanted(table(spark, sf_dir, "orders")), "o_orderkey", "priority")


@query("requeue_versions", "SELECT o_orderkey, CASE WHEN o_orderpriority >= '3' THEN o_orderdate END AS parsed_at FROM orders WHERE o_orderstatus = 'O'")
def requeue_versions(spark, sf_dir):
    """Details made by an older version of the rules lose the day they were made on, and so are made again."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderpriority") >= "3", F.col("o_orderdate")).alias("parsed_at"))


@query("failure_breaker", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, 10 * count(*) FILTER (WHERE event_type = 'error') > count(*) AS stopped FROM events GROUP BY 1")
def failure_breaker(spark, sf_dir):
    """Runs stop where more than a tenth fails."""
    runs = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return runs.withColumn("stopped", 10 * F.col("failed") > F.col("n"))


@query(
    "trial_promotion",
    """WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id),
            s AS (SELECT e.user_id, count(*) FILTER (WHERE event_type NOT IN ('error', 'view') AND (failed IS NULL OR (ts, event_id) > failed)) AS streak FROM events e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id)
       SELECT user_id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS promoted FROM s""",
)
def trial_promotion(spark, sf_dir):
    """The streak after each trial's last run; blocked runs (here: views) keep it, three successes promote."""
    kind = F.col("event_type")
    runs = streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind != "error", kind == "view")
    last = runs.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).alias("streak"))
    return last.withColumn("promoted", F.col("streak") >= 3)


@query(
    "recently_viewed_latest",
    """SELECT user_id, k, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k) AS rn FROM (
         SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(ts) AS ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL)) WHERE rn <= 20""",
)
def recently_viewed_latest(spark, sf_dir):
    """Each posting once, at its latest view; the 20 latest of a user."""
    views = table(spark, sf_dir, "events").filter("event_type = 'view' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'")
    latest = views.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.max("ts").alias("ts"))
    return top_per_group(latest, ["user_id"], [F.desc("ts"), F.asc("k")], 20)


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_wins(spark, sf_dir):
    last = F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last.alias("last")).select("o_custkey", "last.*")


@query("random_rows", "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def random_rows(spark, sf_dir):
    """A random choice that a seed repeats."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(50).select("doc_id", "source")


@query("three_way_listing", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON c_nationkey = n_nationkey")
def three_way_listing(spark, sf_dir):
    """Shells with details and captures where there are any."""
    details = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "orders").join(details, "o_custkey", "left").join(places, "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@query(
    "work_queue",
    """SELECT s.user_id, scraped, coalesce(attempts, 0) AS attempts
       FROM (SELECT user_id, max(ts) AS scraped FROM events WHERE event_type = 'view' GROUP BY user_id) s LEFT JOIN (SELECT doc_id, quality FROM labels) j ON j.doc_id = s.user_id
       LEFT JOIN (SELECT user_id, count(*) AS attempts, max(ts) AS failed, max(value) AS worst FROM events WHERE event_type = 'error' GROUP BY user_id) f ON f.user_id = s.user_id
       WHERE coalesce(j.quality, 0) = 0 AND (f.user_id IS NULL OR (worst < 90 AND attempts < 2) OR scraped > failed) ORDER BY scraped, s.user_id LIMIT 100""",
)
def work_queue(spark, sf_dir):
    """Captures without good details, oldest first: never failed, failed once for a passing reason, or captured anew since."""
    events = table(spark, sf_dir, "events")
    seen = events.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("scraped"))
    failed = events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("failed"), F.max("value").alias("worst"))
    details = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), "quality")
    rows = seen.join(details, "user_id", "left").join(failed, "user_id", "left").filter("coalesce(quality, 0) = 0")
    again = F.col("attempts").isNull() | ((F.col("worst") < 90) & (F.col("attempts") < 2)) | (F.col("scraped") > F.col("failed"))
    return rows.filter(again).orderBy("scraped", "user_id").limit(100).select("user_id", "scraped", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(
    "field_agreement",
    f"""SELECT field, count(*) AS n, count(*) FILTER (WHERE stored IS NOT DISTINCT FROM found) AS same, count(*) FILTER (WHERE stored IS NULL AND found IS NOT NULL) AS only_found FROM (
        SELECT 'duration' AS field, pending_duration AS stored, CASE WHEN raw_text LIKE '%16-week%' THEN '16 weeks' END AS found FROM {_CAPTURES}
        UNION ALL SELECT 'stage', stage, CASE WHEN raw_text LIKE '%enrolled%' THEN 'student' END FROM {_CAPTURES}) GROUP BY field""",
)
def field_agreement(spark, sf_dir):
    """How often what is stored and what the text says are the same, by field."""
    pair = lambda field, stored, found: F.struct(F.lit(field).alias("field"), F.col(stored).alias("stored"), found.alias("found"))
    says = lambda phrase, value: F.when(F.col("raw_text").contains(phrase), value)
    long = captures(spark, sf_dir).select(F.explode(F.array(pair("duration", "pending_duration", says("16-week", "16 weeks")), pair("stage", "stage", says("enrolled", "student")))).alias("f")).select("f.*")
    same = F.col("stored").eqNullSafe(F.col("found"))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if(F.col("stored").isNull() & F.col("found").isNotNull()).alias("only_found"))


@query("plausible_values", "SELECT doc_id FROM documents WHERE length(text) <= 220 AND len(regexp_extract_all(text, '[a-z][A-Z]')) < 2")
def plausible_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(C.plausible(F.col("text"))).select("doc_id")


@query("usable_places", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 NOT IN (0, 2, 3)")
def usable_places(spark, sf_dir):
    """Places as they are, with a region code, cut short, with prose, and none."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    name, which = F.col("n_name"), F.col("c_custkey") % 5
    place = F.when(which == 0, "ab").when(which == 1, name).when(which == 2, F.concat(name, F.lit("; requires experience"))).when(which == 4, F.concat(F.lit("Lima , PE;  "), name, F.lit(", ON")))
    return rows.filter(C.usable_place(place, ("experience", "apply"))).select("c_custkey")


@query("eligible_listings", f"SELECT posting_id FROM {_CAPTURES} WHERE length(job_title) >= 3 AND lower(trim(job_title)) <> 'candidate profile' AND NOT lower(raw_text) LIKE '%public service only%' AND NOT lower(raw_text) LIKE '%internal to the public service%'")
def eligible_listings(spark, sf_dir):
    return captures(spark, sf_dir).filter(C.eligible_listing(F.col("job_title"), F.col("raw_text"))).select("posting_id")


@query("pay_ranges", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE coalesce(CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END, '') || ' - ' || CAST(o_custkey + 10 AS VARCHAR) || ' (' || o_orderstatus || ')' END AS shown FROM orders")
def pay_ranges(spark, sf_dir):
    i, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.pay_range(F.when(i == 1, c), F.when(i != 0, c + 10), F.col("o_orderstatus")).alias("shown"))


_JSON = "list_extract([props, '[1, 2]', '[\"a\"', ' ', NULL, '[]', '7'], CAST(event_id % 7 + 1 AS INTEGER))"


@query("json_kinds", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim({_JSON}), '') = '' THEN 'empty' WHEN NOT json_valid({_JSON}) THEN 'malformed' WHEN json_type(TRY_CAST({_JSON} AS JSON)) = 'ARRAY' THEN 'list' ELSE 'other' END AS kind FROM events) GROUP BY kind")
def json_kinds(spark, sf_dir):
    """Malformed JSON apart from JSON that is no list."""
    given = F.element_at(F.array(F.col("props"), *(F.lit(x).cast("string") for x in ("[1, 2]", '["a"', " ", None, "[]", "7"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(C.json_kind(given).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "repaired_tags",
    f"""SELECT posting_id, array_to_string(CASE WHEN stage = 'student' AND NOT list_contains(known, 'student') THEN list_append(known, 'student') ELSE known END, ';') AS tags
        FROM (SELECT posting_id, stage, list_filter([lang, 'fr', stage], lambda t: t IN ('en', 'senior', 'de')) AS known FROM {_CAPTURES})""",
)
def repaired_tags(spark, sf_dir):
    tags = C.repaired_tags(F.array("lang", F.lit("fr"), "stage", "lang"), ("en", "senior", "de"), "student", F.col("stage") == "student")
    return captures(spark, sf_dir).select("posting_id", F.array_join(tags, ";").alias("tags"))


@query("shown_dates", f"SELECT posting_id, CASE WHEN posted IS NULL THEN '' WHEN posted = 'soon' THEN posted ELSE strftime(CAST(left(posted, 10) AS DATE), '%b %-d, %Y') END AS shown FROM {_CAPTURES}")
def shown_dates(spark, sf_dir):
    return captures(spark, sf_dir).select("posting_id", C.shown_date(F.col("posted")).alias("shown"))
