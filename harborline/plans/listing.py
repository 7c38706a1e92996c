"""Listing queries over orders (postings), customer (employers), nation and region (organizations).

``o_orderstatus`` is the posting's state (O open, P pending, F archived); ``o_orderdate`` its deadline or
freshness date; the customer's market segment its source. "Today" is always the constant ``AS_OF``.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ranking import page, top_per_group
from harborline.plans.registry import query
from harborline.sources.tables import table

AS_OF = "2001-06-30"
DEADLINE_CAP = 365


def postings(spark, sf_dir: str) -> DataFrame:
    """The listing view: each order with its source, employer, place and derived columns."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("posting_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("employer"), F.col("c_nationkey").alias("nation_id"),
        F.col("o_orderstatus").alias("status"), day.alias("deadline"), F.col("o_orderdate").alias("freshness"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"), F.datediff(day, F.lit(AS_OF).cast("date")).alias("days_left"),
    )


_VIEW = f"""(SELECT o_orderkey AS posting_id, c_mktsegment AS source, c_name AS employer, c_nationkey AS nation_id, o_orderstatus AS status,
 CAST(o_orderdate AS DATE) AS deadline, o_orderdate AS freshness, o_orderpriority AS priority, o_totalprice AS amount,
 CAST(date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def is_public() -> Column:
    """Active and not past its deadline; pending postings stay open until filled."""
    return ((F.col("status") == "O") & (F.col("deadline") >= F.lit(AS_OF))) | (F.col("status") == "P")


_PUBLIC = f"((status = 'O' AND deadline >= DATE '{AS_OF}') OR status = 'P')"


def deadline_within(days: int) -> Column:
    """-1: any; otherwise from today to ``days`` days on, at most a year."""
    if days < 0:
        return F.lit(True)
    return F.col("days_left").between(0, min(days, DEADLINE_CAP))


def contains(c: str, text: str) -> Column:
    """Case-insensitive; % and _ in ``text`` are ordinary characters."""
    return F.lower(c).contains(text.lower())


@query(
    "recent_by_source",
    """SELECT source, posting_id, freshness FROM (
         SELECT c_mktsegment AS source, o_orderkey AS posting_id, o_orderdate AS freshness,
                row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
         FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O')
       WHERE rn = 1 ORDER BY freshness DESC, posting_id DESC LIMIT 10""",
)
def recent_by_source(spark, sf_dir):
    """The freshest open posting of each source, the ten freshest of these."""
    open_ = postings(spark, sf_dir).filter("status = 'O' AND source IS NOT NULL")
    first = top_per_group(open_, ["source"], [F.desc("freshness"), F.desc("posting_id")])
    return first.select("source", "posting_id", "freshness").orderBy(F.desc("freshness"), F.desc("posting_id")).limit(10)


@query("listing_view", f"SELECT posting_id, source, employer, status, deadline, days_left, CASE WHEN status = 'F' OR days_left < 0 THEN 1 ELSE 0 END AS is_expired, CASE WHEN status = 'P' THEN 'open_until_filled' WHEN days_left < 0 THEN 'passed' ELSE 'known' END AS deadline_status FROM {_VIEW}")
def listing_view(spark, sf_dir):
    expired = F.when((F.col("status") == "F") | (F.col("days_left") < 0), 1).otherwise(0)
    state = F.when(F.col("status") == "P", "open_until_filled").when(F.col("days_left") < 0, "passed").otherwise("known")
    return postings(spark, sf_dir).select("posting_id", "source", "employer", "status", "deadline", "days_left", expired.alias("is_expired"), state.alias("deadline_status"))


@query("public_postings", f"SELECT posting_id, source, deadline FROM {_VIEW} WHERE {_PUBLIC}")
def public_postings(spark, sf_dir):
    return postings(spark, sf_dir).filter(is_public()).select("posting_id", "source", "deadline")


@query("closing_soon_top10", f"SELECT posting_id, deadline FROM {_VIEW} WHERE status = 'O' AND days_left BETWEEN 0 AND 14 ORDER BY deadline, posting_id LIMIT 10")
def closing_soon(spark, sf_dir):
    return postings(spark, sf_dir).filter((F.col("status") == "O") & deadline_within(14)).select("posting_id", "deadline").orderBy("deadline", "posting_id").limit(10)


@query("home_counters", f"SELECT count(*) AS total, CAST(coalesce(sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END), 0) AS BIGINT) AS active, CAST(coalesce(sum(CASE WHEN days_left BETWEEN 0 AND 14 THEN 1 ELSE 0 END), 0) AS BIGINT) AS closing_soon, max(freshness) AS newest FROM {_VIEW}")
def home_counters(spark, sf_dir):
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return postings(spark, sf_dir).agg(F.count("*").alias("total"), count(F.col("status") == "O").alias("active"), count(deadline_within(14)).alias("closing_soon"), F.max("freshness").alias("newest"))


_PAGE = "SELECT posting_id, deadline, days_left FROM {view} WHERE status = 'O' AND {where} ORDER BY {order} LIMIT 50"
_FRESH = "freshness DESC, posting_id DESC"


def _list_page(days: int):
    def run(spark, sf_dir):
        rows = postings(spark, sf_dir).filter((F.col("status") == "O") & deadline_within(days)).select("posting_id", "deadline", "days_left", "freshness")
        order = [F.asc("deadline"), F.desc("posting_id")] if days >= 0 else [F.desc("freshness"), F.desc("posting_id")]
        return page(rows, order).drop("freshness")

    return run


for _name, _days, _where in (("none", -1, "true"), ("0", 0, "days_left = 0"), ("7", 7, "days_left BETWEEN 0 AND 7"), ("capped", 9999, "days_left BETWEEN 0 AND 365")):
    query(f"list_page_deadline_{_name}", _PAGE.format(view=_VIEW, where=_where, order=_FRESH if _days < 0 else "deadline, posting_id DESC"))(_list_page(_days))


@query("list_page_new", _PAGE.format(view=_VIEW, where="days_left BETWEEN -7 AND 0", order=_FRESH).replace("LIMIT 50", "LIMIT 20 OFFSET 5"))
def list_page_new(spark, sf_dir):
    """The second page of what was added within seven days."""
    rows = postings(spark, sf_dir).filter((F.col("status") == "O") & F.col("days_left").between(-7, 0))
    return page(rows, [F.desc("freshness"), F.desc("posting_id")], 20, 5).select("posting_id", "deadline", "days_left")


@query("list_totals", f"SELECT count(*) AS total, CAST(coalesce(sum(CASE WHEN {_PUBLIC} THEN 1 ELSE 0 END), 0) AS BIGINT) AS available FROM {_VIEW}")
def list_totals(spark, sf_dir):
    return postings(spark, sf_dir).agg(F.count("*").alias("total"), F.coalesce(F.sum(is_public().cast("int")), F.lit(0)).alias("available"))


@query("source_in", f"SELECT posting_id, source FROM {_VIEW} WHERE source IN ('BUILDING', 'MACHINERY')")
def source_in(spark, sf_dir):
    return postings(spark, sf_dir).filter(F.col("source").isin("BUILDING", "MACHINERY")).select("posting_id", "source")


@query("organization_expansion", f"SELECT posting_id, source FROM {_VIEW} v JOIN nation ON nation_id = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def organization_expansion(spark, sf_dir):
    """Postings of all members of an organization group."""
    members = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return postings(spark, sf_dir).join(members, F.col("nation_id") == F.col("n_nationkey"), "left_semi").select("posting_id", "source")


@query("near_place", f"SELECT posting_id, n_name AS place FROM {_VIEW} v JOIN nation ON nation_id = n_nationkey WHERE contains(lower(n_name), 'n_1')")
def near_place(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter(contains("n_name", "N_1"))
    return postings(spark, sf_dir).join(nation, F.col("nation_id") == F.col("n_nationkey")).select("posting_id", F.col("n_name").alias("place"))


@query("search_text", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def search_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(contains("text", "license") | contains("source", "src1")).select("doc_id", "source")


@query("location_terms_any", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_2') OR contains(lower(n_name), 'n_7')")
def location_terms_any(spark, sf_dir):
    from harborline.functions.text import string_list

    nation = table(spark, sf_dir, "nation").filter(F.exists(string_list(F.lit("Nation_2; n_7,")), lambda t: F.lower("n_name").contains(F.lower(t))))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("mode_in", f"SELECT posting_id, priority FROM {_VIEW} WHERE priority IN ('1-URGENT', '2-HIGH')")
def mode_in(spark, sf_dir):
    return postings(spark, sf_dir).filter(F.col("priority").isin("1-URGENT", "2-HIGH")).select("posting_id", "priority")


@query("salary_min_yearly", f"SELECT posting_id, amount FROM {_VIEW} WHERE status = 'O' AND amount >= 150000")
def salary_min_yearly(spark, sf_dir):
    """Only open postings state a yearly amount; others never pass the filter."""
    period = F.when(F.col("status") == "O", "yearly").otherwise("hourly")
    return postings(spark, sf_dir).filter((period == "yearly") & (F.col("amount") >= 150000)).select("posting_id", "amount")


@query("languages_all", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source HAVING bool_or(lang = 'en') AND bool_or(lang = 'fr')")
def languages_all(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return langs.filter(F.forall(F.array(F.lit("en"), F.lit("fr")), lambda want: F.exists("langs", lambda x: x == want)))


@query("urgency_order", f"SELECT posting_id, days_left FROM {_VIEW} WHERE status = 'O' ORDER BY CASE WHEN days_left BETWEEN 0 AND 14 THEN 0 ELSE 1 END, CASE WHEN days_left BETWEEN 0 AND 14 THEN days_left END, freshness DESC, posting_id DESC LIMIT 100")
def urgency_order(spark, sf_dir):
    urgent = deadline_within(14)
    order = [F.when(urgent, 0).otherwise(1), F.when(urgent, F.col("days_left")).asc_nulls_last(), F.desc("freshness"), F.desc("posting_id")]
    return page(postings(spark, sf_dir).filter("status = 'O'"), order, 100).select("posting_id", "days_left")


@query("title_suggestions", "SELECT DISTINCT p_name AS title FROM part ORDER BY lower(title), title LIMIT 50")
def title_suggestions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct().orderBy(F.lower("title"), "title").limit(50)


@query("pending_details", "SELECT d.doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS details_pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pending_details(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(1))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "quality", F.when(F.col("there").isNull(), 1).otherwise(0).alias("details_pending"))


@query("point_lookup_fallback", "SELECT posting_id, store FROM (SELECT o_orderkey AS posting_id, CASE WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'current' END AS store FROM orders WHERE o_orderkey IN (1, 2, 3, 40, 500))")
def point_lookup_fallback(spark, sf_dir):
    """Rows by id from the current store, else from the archive."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 2, 3, 40, 500))
    part = lambda where, name, rank: orders.filter(where).select(F.col("o_orderkey").alias("posting_id"), F.lit(name).alias("store"), F.lit(rank).alias("rank"))
    both = part("o_orderstatus <> 'F'", "current", 0).unionByName(part("o_orderstatus = 'F'", "archive", 1))
    return top_per_group(both, ["posting_id"], [F.asc("rank")]).drop("rank")
