"""What postings say of themselves: each document's text, behind it lines with a title and with announcements in turn."""
from pyspark.sql import functions as F

from harborline.functions import announcements as A
from harborline.plans.deadlines import AS_OF, _date
from harborline.plans.education import described, descriptions
from harborline.plans.registry import query
from harborline.plans.sql import flat, plain, quote

BLOCKS = (
    "title: Planner (12-month contract)\nDate Posted: July 9, 2024 Closing date: August 1, 2024\nkind: Ongoing_Recruitment\nThis posting is intended to create a candidate pool for future vacancies.",
    "title: Clerk - Term\nposted onPosted YesterdayJob requisition id 12\nkind: standard\nVacancy Type: This is for all current and future permanent part-time vacancies.",
    "title: Firefighter (Eligibility List)\nPosted 10 Days Ago\nOpening date: 2024-02-30\nPosting date (EST) - 2024-03-01\nPosted Today time left\nkind: talent inventory",
    "title: Co-op Students - Various Positions\nAdvertised on Tuesday, January 9, 2024\nkind:  open-until filled\nThe office is hiring in spring. Dispatchers apply elsewhere.",
    "title: Nurse (Permanent, Full-Time)\nPublication date: 06/26/2024\nposted todays\nYou are not applying for a specific job, but to our own inventory; managers\nkind: other",
    "title: Analyst – approx. 18 months\nPosted: 2031-01-01\nWe are hiring experienced 9-1-1 police dispatchers.\nPosting date: Mar 4, 2024",
    "title: Contract, Community Worker\nreposted 2024-01-01\nPool to be created\nYes\nkind: Inventory",
    "title: Clerk\nApplications will be accepted until filled.\nMonitor budgets throughout the year.",
)

_D = f"d AS ({described(BLOCKS)}), c AS (SELECT doc_id, description, {flat('description')} AS t, regexp_extract(description, '(?m)^title: (.*)$', 1) AS title, regexp_extract(description, '(?m)^kind: (.*)$', 1) AS kind, doc_id % 97 = 0 AS flagged FROM d)"


def _rows(spark, sf_dir):
    text = F.col("description")
    return descriptions(spark, sf_dir, BLOCKS).withColumns({"title": F.regexp_extract(text, "(?m)^title: (.*)$", 1), "kind": F.regexp_extract(text, "(?m)^kind: (.*)$", 1), "flagged": F.col("doc_id") % 97 == 0})


@query(
    "posted_dates",
    f"""WITH {_D}, found AS (SELECT doc_id, i, {_date('ms[i]', 1)} AS day FROM (SELECT doc_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quote(A.POSTED_DATE)}, 1) AS ms FROM c))),
        firsts AS (SELECT doc_id, arg_min(day, i) AS posted FROM found WHERE day IS NOT NULL GROUP BY doc_id),
        words AS (SELECT doc_id, lower(regexp_extract(t, {quote(A.RELATIVE)}, 1)) AS w FROM c)
        SELECT doc_id, posted, CASE w WHEN 'today' THEN DATE '{AS_OF}' WHEN 'yesterday' THEN CAST(DATE '{AS_OF}' - 1 AS DATE) END AS recent FROM words LEFT JOIN firsts USING (doc_id)""",
)
def posted_dates(spark, sf_dir):
    text, as_of = F.col("description"), F.lit(AS_OF)
    return _rows(spark, sf_dir).select("doc_id", A.posted_date(text, as_of).alias("posted"), A.recently_posted(text, as_of).alias("recent"))


_terms = " ".join(f"WHEN contains(w, {quote(f' {p} ')}) THEN {quote(label)}" for label, p in A.TERMS)


@query(
    "title_durations",
    f"""WITH {_D}, ts AS (SELECT doc_id, {flat('title')} AS t FROM c),
        asides AS (SELECT doc_id, array_to_string(regexp_extract_all(t, '\\(([^()]*)\\)', 1), ' ') || ' ' || regexp_extract(t, {quote(A.TAIL)}, 1) || CASE WHEN regexp_matches(t, {quote(f"^{A.any_of(A.TERM_HEADS, '[ -]?')} ?[,;] ?.")}) THEN ' ' || t ELSE '' END
          || ' ' || regexp_extract(t, {quote(f"{chr(92)}b({A.any_of(A.TERM_ENDS)})$")}, 1) AS a FROM ts),
        said AS (SELECT doc_id, trim(regexp_extract(a, {quote(A.SPAN)})) AS span, {plain('a')} AS w FROM asides)
        SELECT doc_id, CASE WHEN span <> '' THEN span {_terms} END AS duration FROM said""",
)
def title_durations(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", A.title_duration(F.col("title")).alias("duration"))


_rules = " ".join(f"WHEN regexp_matches({'title' if where == 'title' else 'said'}, {quote(A.kind_pattern(*rule))}) THEN {quote(kind)}" for kind, where, *rule in A.KINDS)
_stored = " ".join(f"WHEN k IN ({', '.join(map(quote, names))}) THEN {quote(kind)}" for kind, names in A.STORED_KINDS)


@query(
    "listing_kinds",
    f"""WITH {_D}, texts AS (SELECT *, title || chr(10) || description AS said, trim(regexp_replace(lower(kind), '[\\s_-]+', ' ', 'g')) AS k FROM c)
        SELECT doc_id, CASE WHEN flagged THEN 'inventory' {_rules} ELSE 'regular' END AS found, CASE WHEN flagged THEN 'inventory' {_stored} ELSE 'regular' END AS stored FROM texts""",
)
def listing_kinds(spark, sf_dir):
    """The kind that title and text tell, and the one that the stored value means."""
    return _rows(spark, sf_dir).select("doc_id", A.listing_kind(F.col("title"), F.col("description"), F.col("flagged")).alias("found"), A.stored_kind(F.col("kind"), F.col("flagged")).alias("stored"))
