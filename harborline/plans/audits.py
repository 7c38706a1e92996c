"""Data quality: vocabularies, completeness, quotas, parity, repeated lines and page extraction."""
from pyspark.sql import functions as F

from harborline.functions import html, text
from harborline.operators.ranking import quotas, stable_sample
from harborline.plans.registry import query
from harborline.sources.tables import table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query(
    "vocab_report",
    """SELECT field, value, count(*) AS n, list_sort(list(id))[1:5] AS examples FROM (
         SELECT o_orderkey AS id, 'priority' AS field, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
         UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
       GROUP BY field, value ORDER BY field, n DESC, value""",
)
def vocab_report(spark, sf_dir):
    """Values outside the controlled vocabularies, with counts and the five smallest ids as examples."""
    pairs = F.array(F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")))
    long = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(pairs).alias("p")).select("id", "p.*")
    odd = long.filter(((F.col("field") == "priority") & ~F.col("value").isin(*PRIORITIES)) | ((F.col("field") == "status") & ~F.col("value").isin("O", "F")))
    counts = odd.groupBy("field", "value").agg(F.count("*").alias("n"))
    from harborline.operators.ranking import top_per_group

    examples = top_per_group(odd, ["field", "value"], [F.asc("id")], 5).groupBy("field", "value").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    return counts.join(examples, ["field", "value"]).orderBy("field", F.desc("n"), "value")


@query("completeness_flags", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_details, CAST(sum(CASE WHEN length(text) < 100 THEN 1 ELSE 0 END) AS BIGINT) AS short_text, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS low_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def completeness_flags(spark, sf_dir):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    labels = table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), count(F.col("there").isNull()).alias("no_details"), count(F.length("text") < 100).alias("short_text"), count(F.col("quality") == 0).alias("low_quality"))


@query("stable_hash_sample", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 3")
def stable_hash_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stable_sample(docs, "source", "doc_id", docs.select("source").distinct().withColumn("quota", F.lit(3))).select("source", "doc_id")


@query(
    "source_quota",
    """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
            t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS whole, CAST(ceil(CAST(sum(n) OVER () AS BIGINT) * 0.02::DOUBLE) AS BIGINT) AS target FROM g),
            e AS (SELECT *, least(n, greatest(1, n * target // whole)) AS base, n * target % whole AS rest FROM t),
            gap AS (SELECT CAST(max(target) - sum(base) AS BIGINT) AS d FROM e),
            up AS (SELECT source FROM (SELECT source, rest, unnest(range(0, n - base)) AS k FROM e) ORDER BY k, rest DESC, source LIMIT (SELECT greatest(d, 0) FROM gap)),
            down AS (SELECT source FROM (SELECT source, rest, unnest(range(1, base)) AS k FROM e) ORDER BY k, rest, source LIMIT (SELECT greatest(-d, 0) FROM gap))
       SELECT source, n, CAST(base + (SELECT count(*) FROM up WHERE up.source = e.source) - (SELECT count(*) FROM down WHERE down.source = e.source) AS BIGINT) AS quota FROM e""",
)
def source_quota(spark, sf_dir):
    return quotas(table(spark, sf_dir, "documents"), "source", 0.02)


@query("row_parity_hash", "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS row_hash FROM orders")
def row_parity_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("row_hash"))


@query("dup_lines", "SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS INTEGER) AS n_dup FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents)")
def dup_lines(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("ls")).select("doc_id", F.size("ls").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).alias("n_dup"))


@query("repeated_lines", "SELECT line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40 GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") >= 40)
    return lines.groupBy("line").agg(F.count("*").alias("docs")).filter("docs > 1")


@query("role_carry_forward", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def role_carry_forward(spark, sf_dir):
    """Each turn with the turn of the question that it belongs to."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before).alias("asked_at"))


@query("thread_text", "SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def thread_text(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("digest"))


@query("json_prop", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("slug", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[.'']', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("url_id", "SELECT page_id, substr(sha256(url), 1, 12) AS url_id FROM pages")
def url_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_id(F.col("url")).alias("url_id"))


@query("collapse_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s]+', ' ', 'g'))) AS digest FROM documents")
def collapse_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _n, _v in html.ENTITIES:
    _TITLE = f"replace({_TITLE}, '{_n}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query("html_title", f"SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


_TEXT = "html"
for _p in (r"(?s)<!--.*?-->", *(rf"(?is)<{_t}\b[^>]*>.*?</{_t}>" for _t in html.NOISE), "<[^>]*>"):
    _TEXT = f"regexp_replace({_TEXT}, '{_p}', ' ', 'g')"
for _n, _v in html.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_n}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query("html_text", f"SELECT page_id, trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


@query("html_links", """SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>.*?</a>', 1)) AS href FROM pages) GROUP BY ALL""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("a")).select("page_id", F.col("a.href").alias("href")).distinct()
