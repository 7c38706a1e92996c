"""Overviews: each document's text as the middle paragraph, among paragraphs that advertise or describe the work."""
from pyspark.sql import functions as F

from harborline.functions import overviews as O
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, plain, quote
from harborline.sources.tables import table

#: (title, before, after)
FRAMES = (
    ("Water Operator (Temporary)", "Our city is a vibrant community with a growing economy. It offers quality of life.", "We are proud to be here. The Water Operator runs the plant. Duties are many."),
    ("Clerk", "About the role:\n\nA population of 50,000 lives here. This role is responsible for files.", "Follow us on Facebook."),
    ("", "Known as the best town. World-class parks. You will provide support.", "Beautiful city. Never been a better time!"),
    ("Client Services Representative, Visual Arts", "A town. A client services representative meets people. They talk.", "Your opportunity"),
    ("Nobody", "", ""),
    (None, "The opportunity: Live, work and play in a beautiful town. Apply to us.", "An expanding population. A plant. A park."),
)
LINES = ("- Skip to main content", "Learn more about us on LinkedIn.", "Print", "Share this page", "We are an Equal Opportunity Employer.\nSecond line", "A line that stays\n- Apply now\nCookie policy", "Apply now to join", "")


def _dealt(values):
    return F.element_at(F.array(*values), (F.col("doc_id") % len(values) + 1).cast("int"))


def _frames(spark, sf_dir):
    frame = _dealt([F.struct(F.lit(t).cast("string").alias("title"), F.lit(a).alias("before"), F.lit(z).alias("after")) for t, a, z in FRAMES])
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", frame.alias("f"))
    return rows.select("doc_id", "f.title", F.concat_ws("\n\n", "f.before", F.coalesce("text", F.lit("")), "f.after").alias("overview"))


_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_sentences = lambda p: f"list_filter(list_transform(string_split(regexp_replace({p}, {quote(O.SENTENCE)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda y: {_strip('y')}), lambda y: y <> '')"
_work = lambda s: has_phrase(plain(s), O.WORK)
_town = lambda s: f"(({has_phrase(plain(s), O.TOWN)} OR regexp_matches({plain(s)}, {quote(O.TOWN_NUMBERS)})) AND NOT {_work(s)})"
_titled = lambda s: f"(length(core) >= {O.TITLE} AND (contains(lower({s}), core) OR (length(head) >= {O.HEAD} AND contains(lower({s}), head))))"


def _judged(name: str, source: str) -> str:
    """CTE ``name``: the paragraphs of ``source`` (doc_id, n, p) with what their sentences say."""
    return f"""{name}_s AS (SELECT doc_id, n, k, ss[k] AS s FROM (SELECT doc_id, n, ss, unnest(range(1, len(ss) + 1)) AS k FROM (SELECT doc_id, n, {_sentences('p')} AS ss FROM {source}))),
 {name}_f AS (SELECT s.*, {_town('s')} AS town, {_titled('s')} AS titled, {_work('s')} AS work FROM {name}_s s JOIN d USING (doc_id)),
 {name} AS (SELECT doc_id, n, count(*) FILTER (town) > 0 AND 2 * count(*) FILTER (town) >= count(*) AND NOT bool_or(titled OR work) AS ad, coalesce(min(k) FILTER (titled), min(k) FILTER (NOT town)) AS start FROM {name}_f GROUP BY doc_id, n)"""


_SQL = f"""WITH raw AS (SELECT doc_id, coalesce(list_extract([{', '.join('NULL' if t is None else quote(t) for t, _, _ in FRAMES)}], CAST(doc_id % {len(FRAMES)} + 1 AS INTEGER)), '') AS title,
   list_extract([{', '.join(quote(a) for _, a, _ in FRAMES)}], CAST(doc_id % {len(FRAMES)} + 1 AS INTEGER)) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || list_extract([{', '.join(quote(z) for _, _, z in FRAMES)}], CAST(doc_id % {len(FRAMES)} + 1 AS INTEGER)) AS overview FROM documents),
 t AS (SELECT doc_id, {_strip('overview')} AS whole, lower({flat("regexp_replace(title, '\\s*\\([^)]*\\)\\s*$', '')")}) AS core FROM raw), d AS (SELECT *, trim(regexp_extract(core, '^[^,–—-]*')) AS head FROM t),
 lists AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(whole, '\\n\\s*\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM d),
 p1 AS (SELECT doc_id, n, ps[n] AS p, len(ps) AS size FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM lists)), {_judged('j1', 'p1')},
 starts AS (SELECT doc_id, any_value(size) AS size, greatest(coalesce(min(n) FILTER (NOT ad), any_value(size) + 1), coalesce(min(n) FILTER (length(core) >= {O.TITLE} AND (contains(lower(p), core) OR contains(lower(p), head))), 0)) AS start FROM p1 JOIN j1 USING (doc_id, n) JOIN d USING (doc_id) GROUP BY doc_id),
 cut AS (SELECT doc_id, n, CASE WHEN any_value(j.start) IS NULL THEN any_value(p) ELSE {_strip(f"regexp_replace(string_agg(s, ' ' ORDER BY k) FILTER (k >= j.start), {quote(O.OPENER)}, '')")} END AS p FROM p1 JOIN j1 j USING (doc_id, n) JOIN j1_f USING (doc_id, n) GROUP BY doc_id, n),
 p2 AS (SELECT c.* FROM cut c JOIN starts s USING (doc_id) WHERE n >= least(start, size) AND p <> ''), {_judged('j2', 'p2')},
 res AS (SELECT d.doc_id, CASE WHEN size IS NULL THEN whole WHEN s.start > size THEN coalesce(any_value(p2.p), whole)
   ELSE coalesce(string_agg(p2.p, chr(10) || chr(10) ORDER BY n) FILTER (NOT coalesce(ad, FALSE) AND NOT regexp_matches(p2.p, {quote(O.OPENER_ALONE)})), '') END AS r, any_value(whole) AS whole, any_value(s.start > size) AS rescued
   FROM d LEFT JOIN starts s USING (doc_id) LEFT JOIN p2 USING (doc_id) LEFT JOIN j2 USING (doc_id, n) GROUP BY d.doc_id, size, whole, s.start)
SELECT doc_id, md5(CASE WHEN rescued OR regexp_matches(r, '[.!?](\\s|$)') THEN r ELSE whole END) AS digest, CAST(length(CASE WHEN rescued OR regexp_matches(r, '[.!?](\\s|$)') THEN r ELSE whole END) AS BIGINT) AS chars FROM res"""


@query("overviews_cleaned", _SQL)
def overviews_cleaned(spark, sf_dir):
    """Each overview from its first paragraph on the work on."""
    cleaned = _frames(spark, sf_dir).select("doc_id", O.clean_overview(F.col("overview"), F.col("title")).alias("r"))
    return cleaned.select("doc_id", F.md5("r").alias("digest"), F.length("r").cast("long").alias("chars"))


_line = f"list_extract([{', '.join(map(quote, LINES))}], CAST(doc_id % {len(LINES)} + 1 AS INTEGER))"


@query(
    "furniture_removed",
    f"""WITH b AS (SELECT doc_id, {_line} || chr(10) || chr(10) || coalesce(text, '') || chr(10) || {_line} AS t FROM documents), p AS (SELECT doc_id, n, ps[n] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array(t, '\\n\\s*\\n+') AS ps FROM b))),
        l AS (SELECT doc_id, n, k, ls[k] AS x FROM (SELECT doc_id, n, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, n, string_split(p, chr(10)) AS ls FROM p))),
        kept AS (SELECT doc_id, n, {_strip("string_agg(x, chr(10) ORDER BY k)")} AS p FROM l WHERE NOT regexp_matches(lower({_strip("regexp_replace(x, '^\\s*[-•]\\s*', '')")}), {quote(O.FURNITURE_LINE)}) GROUP BY doc_id, n)
        SELECT b.doc_id, md5(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY n) FILTER (p <> '' AND NOT ({' OR '.join(f"contains(lower(p), {quote(e)})" for e in O.EQUITY)})), '')) AS digest FROM b LEFT JOIN kept USING (doc_id) GROUP BY b.doc_id""",
)
def furniture_removed(spark, sf_dir):
    line = _dealt([F.lit(x) for x in LINES])
    body = table(spark, sf_dir, "documents").select("doc_id", F.concat(line, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("body"))
    return body.select("doc_id", F.md5(O.without_furniture(F.col("body"))).alias("digest"))
