"""The listing view's derived columns and filters over captures: each document is a captured posting, its label
the parsed details. Phrases that the made-up texts lack stand behind them, in turn."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import posting_fields as P
from harborline.plans.registry import query
from harborline.sources.tables import table

AS_OF = "2001-06-30"
PHRASES = (
    "Full-time role", "part time evenings", "Temporary cover", "a 16-week placement", "up to two years of training", "fixed term", "Eligibility List", "candidate pool", "open until filled",
    "until filled; application deadline to follow", "accepting applications until filled", "no deadline", "Closing date: TBD", "nothing else", "high school diploma", "currently enrolled", "Master of arts",
)
_LIST = ", ".join(f"'{p}'" for p in PHRASES)


def captures(spark, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("parsed", F.lit(True))
    i, q = F.col("doc_id"), F.col("quality")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES) + 1).cast("int"))
    choose = lambda n, *values: F.element_at(F.array(*(v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string") for v in values)), (i % n + 1).cast("int"))
    return d.join(labels, "doc_id", "left").select(
        i.alias("posting_id"), "source", "lang", F.coalesce("parsed", F.lit(False)).alias("parsed"), q.alias("quality"), F.col("toxic").alias("flagged"),
        choose(5, "Skip to main content", "  ", None, F.concat(F.lit("Role "), i.cast("string")), "Analyst ").alias("job_title"), choose(3, " skip to results", F.concat(F.col("source"), F.lit(" posting ")), "").alias("title"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("raw_text"), phrase.alias("education"),
        choose(6, None, "", "null", "N/A", " 2001-07-15 ", "2001-06-30").alias("closing"), choose(4, None, "NULL", "2001-08-01T10:00", " ").alias("pending_closing"), choose(4, None, "blocked", "not_listed", None).alias("pending_status"),
        F.when(q == 1, choose(3, "Casual", None, None)).alias("stored_type"), choose(7, None, None, "6 months", None, None, None, None).alias("pending_duration"), choose(5, "2001-06-01", "2001-12-31", "soon", None, "2001-06-30T08:00").alias("posted"),
        F.date_add(F.lit("2001-01-01").cast("date"), (i % 180).cast("int")).alias("first_seen"), choose(5, None, "student", "senior", "early-career", "other").alias("stage"), choose(4, "English;French", "Bilingual", "english", "").alias("languages"),
    )


def _choose(n: int, *values: str) -> str:
    return f"list_extract([{', '.join(values)}], CAST(d.doc_id % {n} + 1 AS INTEGER))"


_CAPTURES = f"""(SELECT d.doc_id AS posting_id, source, lang, l.doc_id IS NOT NULL AS parsed, quality, toxic AS flagged,
 {_choose(5, "'Skip to main content'", "'  '", "NULL", "'Role ' || d.doc_id", "'Analyst '")} AS job_title, {_choose(3, "' skip to results'", "source || ' posting '", "''")} AS title,
 coalesce(text, '') || ' ' || {_choose(len(PHRASES), _LIST)} AS raw_text, {_choose(len(PHRASES), _LIST)} AS education,
 {_choose(6, "NULL", "''", "'null'", "'N/A'", "' 2001-07-15 '", "'2001-06-30'")} AS closing, {_choose(4, "NULL", "'NULL'", "'2001-08-01T10:00'", "' '")} AS pending_closing, {_choose(4, "NULL", "'blocked'", "'not_listed'", "NULL")} AS pending_status,
 CASE WHEN quality = 1 THEN {_choose(3, "'Casual'", "NULL", "NULL")} END AS stored_type, {_choose(7, "NULL", "NULL", "'6 months'", "NULL", "NULL", "NULL", "NULL")} AS pending_duration,
 {_choose(5, "'2001-06-01'", "'2001-12-31'", "'soon'", "NULL", "'2001-06-30T08:00'")} AS posted, CAST(DATE '2001-01-01' + CAST(d.doc_id % 180 AS INTEGER) AS DATE) AS first_seen,
 {_choose(5, "NULL", "'student'", "'senior'", "'early-career'", "'other'")} AS stage, {_choose(4, "'English;French'", "'Bilingual'", "'english'", "''")} AS languages
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_TEXT = f"(SELECT *, lower(coalesce(title, '') || ' ' || raw_text) AS st FROM {_CAPTURES})"
_STATED = "CASE WHEN trim({0}) NOT IN ('', 'null', 'NULL', 'N/A') THEN trim({0}) END"
_CLOSING = f"coalesce({_STATED.format('closing')}, {_STATED.format('pending_closing')})"
_TITLE = "CASE WHEN lower(trim({0})) LIKE 'skip to%' THEN NULL ELSE nullif(trim({0}), '') END"
_KIND = """CASE WHEN parsed THEN 'regular' WHEN st LIKE '%eligibility list%' OR st LIKE '%candidate inventory%' OR st LIKE '%inventory for future%' OR st LIKE '%not applying for a specific job%' THEN 'inventory'
 WHEN st LIKE '%hiring pool%' OR st LIKE '%candidate pool%' OR st LIKE '%talent pool%' OR st LIKE '%ongoing recruitment%' THEN 'ongoing_recruitment' ELSE 'regular' END"""
_FRESH = f"CASE WHEN try_cast(left(posted, 10) AS DATE) <= DATE '{AS_OF}' THEN try_cast(left(posted, 10) AS DATE) ELSE first_seen END"


def _view(spark, sf_dir: str) -> DataFrame:
    text = P.source_text(F.col("title"), F.col("raw_text"))
    rows = captures(spark, sf_dir).withColumn("st", text)
    kind = P.listing_type(F.lit(None).cast("string"), F.col("parsed"), F.col("st"))
    return rows.withColumns({"closing_date": P.first_stated(F.col("closing"), F.col("pending_closing")), "listing_type": kind, "freshness": P.freshness_date(F.col("posted"), F.col("first_seen"), F.lit(AS_OF).cast("date"))}).withColumn("is_inventory", P.is_inventory(F.col("flagged"), F.col("listing_type")))


@query(
    "posting_view_columns",
    f"""SELECT posting_id, coalesce({_TITLE.format('job_title')}, {_TITLE.format('title')}) AS public_title, {_CLOSING} AS closing_date, md5(st) AS text_md5,
        coalesce(stored_type, CASE WHEN st LIKE '%full-time%' OR st LIKE '%full time%' THEN 'Full-time' WHEN st LIKE '%part-time%' OR st LIKE '%part time%' THEN 'Part-time' WHEN st LIKE '%temporary%' OR st LIKE '%contract%' THEN 'Contract' END) AS employment_type,
        CASE WHEN st LIKE '%16-week%' OR st LIKE '%16 week%' THEN '16 weeks' WHEN st LIKE '%up to two years%' THEN 'Training up to 2 years' WHEN pending_duration IS NOT NULL THEN pending_duration WHEN st LIKE '%fixed-term%' OR st LIKE '%fixed term%' THEN 'Term' END AS duration,
        {_KIND} AS listing_type, CASE WHEN coalesce(flagged, 0) = 1 OR {_KIND} = 'inventory' THEN 1 ELSE 0 END AS is_inventory, {_FRESH} AS freshness FROM {_TEXT}""",
)
def posting_view_columns(spark, sf_dir):
    st = F.col("st")
    return _view(spark, sf_dir).select(
        "posting_id", P.public_title(F.col("job_title"), F.col("title")).alias("public_title"), "closing_date", F.md5(st).alias("text_md5"), P.employment_type(F.col("stored_type"), st).alias("employment_type"),
        P.duration(F.lit(None).cast("string"), F.col("pending_duration"), st).alias("duration"), "listing_type", "is_inventory", "freshness",
    )


@query(
    "closing_date_status",
    f"""SELECT posting_id, CASE WHEN {_CLOSING} IS NOT NULL THEN 'known' WHEN pending_status = 'blocked' THEN 'blocked' WHEN NOT parsed THEN coalesce(pending_status, 'not_checked')
        WHEN (st LIKE '%until filled%' AND (st LIKE '%closing date%' OR st LIKE '%application deadline%' OR st LIKE '%posting close%' OR st LIKE '%competition close%')) OR st LIKE '%open till filled%' OR st LIKE '%open until filled%' OR st LIKE '%posted until filled%'
          OR st LIKE '%remains open until filled%' OR st LIKE '%remains active until filled%' OR st LIKE '%open until suitable candidate found%' OR st LIKE '%open until a suitable candidate found%' OR st LIKE '%open until vacancies are filled%' OR st LIKE '%remain active until filled%'
          OR st LIKE '%accepting applications until filled%' THEN 'open_until_filled'
        WHEN st LIKE '%no deadline%' OR st LIKE '%without a deadline%' OR st LIKE '%deadline not listed%' THEN 'not_listed' WHEN st LIKE '%closing date: tbd%' OR st LIKE '%closing date: n/a%' OR st LIKE '%closing date: none%' THEN 'invalid' ELSE 'not_checked' END AS closing_status FROM {_TEXT}""",
)
def closing_date_status(spark, sf_dir):
    return _view(spark, sf_dir).select("posting_id", P.closing_status(F.col("closing_date"), F.col("pending_status"), F.col("parsed"), F.col("st")).alias("closing_status"))


@query("education_levels_any", f"SELECT posting_id, education FROM {_CAPTURES} WHERE lower(education) LIKE '%high school%' OR lower(education) LIKE '%master%'")
def education_levels_any(spark, sf_dir):
    return captures(spark, sf_dir).filter(P.education_levels(F.col("education"), ["high_school", "masters", "unknown"])).select("posting_id", "education")


@query("career_stage_in", f"SELECT posting_id, stage FROM {_CAPTURES} WHERE stage IN ('student', 'senior')")
def career_stage_in(spark, sf_dir):
    return captures(spark, sf_dir).filter(P.career_stages(F.col("stage"), ["student", "senior", "other"])).select("posting_id", "stage")


@query("languages_all_or_bilingual", f"SELECT posting_id, languages FROM {_CAPTURES} WHERE lower(languages) LIKE '%bilingual%' OR (lower(languages) LIKE '%english%' AND lower(languages) LIKE '%french%')")
def languages_all_or_bilingual(spark, sf_dir):
    from harborline.functions.text import string_list

    return captures(spark, sf_dir).filter(P.languages_all(string_list(F.col("languages")), ["English", "French"])).select("posting_id", "languages")


for _mode, _where in ((None, "is_inventory = 0"), ("inventory", "is_inventory = 1"), ("ongoing_recruitment", "listing_type = 'ongoing_recruitment'")):

    @query(f"listing_mode_{_mode or 'default'}", f"SELECT posting_id, listing_type FROM (SELECT posting_id, {_KIND} AS listing_type, CASE WHEN coalesce(flagged, 0) = 1 OR {_KIND} = 'inventory' THEN 1 ELSE 0 END AS is_inventory FROM {_TEXT}) WHERE {_where}")
    def _listing_mode(spark, sf_dir, mode=_mode):
        return _view(spark, sf_dir).filter(P.listing_mode(F.col("listing_type"), F.col("is_inventory"), mode)).select("posting_id", "listing_type")


@query("students_only", f"SELECT posting_id, stage FROM {_CAPTURES} WHERE stage = 'student' AND flagged = 0")
def students_only(spark, sf_dir):
    return captures(spark, sf_dir).filter((F.col("stage") == "student") & (F.col("flagged") == 0)).select("posting_id", "stage")


@query("exact_title", f"SELECT posting_id FROM {_TEXT} WHERE coalesce({_TITLE.format('job_title')}, {_TITLE.format('title')}) = 'Analyst'")
def exact_title(spark, sf_dir):
    return captures(spark, sf_dir).filter(P.public_title(F.col("job_title"), F.col("title")) == "Analyst").select("posting_id")


@query("saved_order", f"SELECT posting_id, parsed, first_seen FROM {_CAPTURES} ORDER BY parsed DESC, first_seen DESC, posting_id LIMIT 100")
def saved_order(spark, sf_dir):
    return captures(spark, sf_dir).orderBy(F.desc("parsed"), F.desc("first_seen"), "posting_id").limit(100).select("posting_id", "parsed", "first_seen")


@query("queue_oldest_first", f"SELECT posting_id, first_seen FROM {_CAPTURES} WHERE NOT parsed ORDER BY first_seen, posting_id LIMIT 50")
def queue_oldest_first(spark, sf_dir):
    return captures(spark, sf_dir).filter("NOT parsed").orderBy("first_seen", "posting_id").limit(50).select("posting_id", "first_seen")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey > 500").orderBy("o_orderkey").limit(1000).select("o_orderkey", "o_totalprice")


@query("directory_order", "SELECT s_name, coalesce(CASE s_name WHEN 'Supplier#000000003' THEN 'acme' END, s_name) AS shown FROM supplier ORDER BY lower(coalesce(CASE s_name WHEN 'Supplier#000000003' THEN 'acme' END, s_name)), s_name LIMIT 50")
def directory_order(spark, sf_dir):
    """By the name that is shown, without regard to case and accents."""
    names = F.create_map(F.lit("Supplier#000000003"), F.lit("acme"))
    rows = table(spark, sf_dir, "supplier").select("s_name", F.coalesce(F.try_element_at(names, F.col("s_name")), F.col("s_name")).alias("shown"))
    return rows.orderBy(F.collate("shown", "UNICODE_CI_AI"), "s_name").limit(50)


@query("stalled_failures", "SELECT count(*) AS stalled FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') >= 2 AND max(ts) FILTER (WHERE event_type = 'error') > coalesce(max(ts) FILTER (WHERE event_type = 'view'), TIMESTAMP '1970-01-01'))")
def stalled_failures(spark, sf_dir):
    """Users with two failures or more and no view after the last."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(of("error")).alias("failures"), F.max(of("error")).alias("failed"), F.max(of("view")).alias("seen"))
    return users.filter((F.col("failures") >= 2) & (F.col("seen").isNull() | (F.col("failed") > F.col("seen")))).agg(F.count("*").alias("stalled"))


@query("source_counts_around_run", "SELECT event_type AS source, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS before, count(*) AS after, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS touched FROM events GROUP BY event_type")
def source_counts_around_run(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-24").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count_if(~late).alias("before"), F.count("*").alias("after"), F.count_if(late).alias("touched"))


@query("lists_equal", f"SELECT posting_id, list_sort(list_distinct(list_transform(string_split(lower(languages), ';'), lambda x: trim(x)))) = ['english', 'french'] AS equal FROM {_CAPTURES}")
def lists_equal(spark, sf_dir):
    return captures(spark, sf_dir).select("posting_id", P.same_set(F.split("languages", ";"), F.array(F.lit("French "), F.lit("ENGLISH"), F.lit("english"))).alias("equal"))


@query("joined_list", f"SELECT posting_id, nullif(array_to_string(list_filter(list_transform(string_split(languages, ';'), lambda x: upper(x)), lambda x: x <> ''), ', '), '') AS shown FROM {_CAPTURES}")
def joined_list(spark, sf_dir):
    return captures(spark, sf_dir).select("posting_id", P.joined(F.split("languages", ";"), F.upper).alias("shown"))


@query("coalesced_fields", f"SELECT posting_id, coalesce(stored_type, pending_duration, lang) AS shown, coalesce(flagged, CASE WHEN stage = 'student' THEN 1 ELSE 0 END) AS is_student FROM {_CAPTURES}")
def coalesced_fields(spark, sf_dir):
    return captures(spark, sf_dir).select("posting_id", F.coalesce("stored_type", "pending_duration", "lang").alias("shown"), F.coalesce("flagged", (F.coalesce(F.col("stage"), F.lit("")) == "student").cast("int")).alias("is_student"))
