"""Places of postings: one of a list of texts for each document, and labels planted behind the documents' texts."""
from pyspark.sql import functions as F

from harborline.operators import places as P
from harborline.plans.registry import query
from harborline.plans.sql import flat, quote
from harborline.sources.tables import table

TEXTS = (
    "Guelph", "toronto, on", "London, Ontario, Canada", "Calgary (AB); Halifax (NS); Montreal (québec)", "Calgary (ab), Halifax (ns), Vancouver, BC", "Bagotville (québec), YT", "Guelph; Toronto; guelph", "Kelowna / Penticton / Salmon Arm", "Edmonton or Calgary",
    "New Westminster/Coquitlam", "Delta, Langley, White Rock", "Keele Campus, Ontario, Canada", "St. George (Downtown Toronto)", "St. Catharines, Main Campus", "Various locations", "Nowhereville", "City of Hamilton", "Fort Frances, ON", "fort mcmurray, ab", "Remote - Toronto", "", "Multiple, ON",
)
LABELLED = (
    "Location: North Bay Department: Parks", "Job Location: Fort Frances, ON Salary: $5", "Primary City: st catharines, and more", "Locations Toronto, ON; Vancouver", "Location: Various. Job location Thunder Bay and around", "A nice location in Guelph", "location: King City hall is near", "Locations: none",
)


def _dealt(texts):
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))


_known = {c: p for p, names in P.CITIES.items() for c in names.split(", ")}
_GAZETTEER = ", ".join([f"({quote(c.lower())}, {quote(c)}, '{p}', FALSE)" for c, p in _known.items()] + [f"({quote(a)}, {quote(c)}, '{_known[c]}', TRUE)" for a, c in P.ALIASES.items()])
_CODES = "MAP {" + ", ".join(f"{quote(n)}: '{code}'" for code, names in P.PROVINCES.items() for n in (code.lower(), *names)) + "}"
_code = lambda x: f"{_CODES}[lower(trim({x}))]"
_junk = lambda x: f"({x} IN ({', '.join(map(quote, P.JUNK))}) OR " + " OR ".join(f"starts_with({x}, {quote(p)})" for p in P.JUNK_START) + ")"
_dealt_sql = lambda texts: f"list_extract([{', '.join(map(quote, texts))}], CAST(doc_id % {len(texts)} + 1 AS INTEGER))"
#: From parts (doc_id, n, part) to candidates with what is known of their names.
_NAMES = f"""s AS (SELECT * EXCLUDE (part), trim(regexp_replace({flat('part')}, {quote(P.CANADA)}, '')) AS s FROM parts),
 cut AS (SELECT *, CASE WHEN regexp_matches(s, {quote(P.BRACKETS)}) THEN regexp_extract(s, {quote(P.BRACKETS)}, ['c', 'p']) WHEN regexp_matches(s, {quote(P.COMMA)}) THEN regexp_extract(s, {quote(P.COMMA)}, ['c', 'p']) END AS m FROM s WHERE NOT {_junk('lower(s)')}),
 city AS (SELECT *, trim(regexp_replace(m.c, {quote(P.CAMPUS)}, '')) AS c, {_code('m.p')} AS p FROM cut),
 cand AS (SELECT * EXCLUDE (m, c, p), 0 AS rank, lower(s) AS name, NULL AS own, NULL AS prov FROM city UNION ALL SELECT * EXCLUDE (m, c, p), 1, lower(c), c, p FROM city WHERE c IS NOT NULL
   UNION ALL SELECT * EXCLUDE (m, c, p), 2, regexp_replace(lower(trim(regexp_replace(s, {quote(P.CAMPUS)}, ''))), '^city of ', ''), NULL, NULL FROM city),
 g AS (SELECT * FROM (VALUES {_GAZETTEER}) AS t(name, city, province, alias)),
 initial AS (SELECT *, array_to_string(list_transform(string_split(lower(own), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled FROM cand WHERE NOT {_junk('name')}),
 got AS (SELECT i.*, CASE WHEN prov IS NULL OR coalesce(alias, FALSE) THEN city || ', ' || province ELSE coalesce(CASE WHEN NOT alias THEN city END, titled) || ', ' || prov END AS place FROM initial i LEFT JOIN g USING (name))"""
_SPLIT = f"""CASE WHEN contains(t, ';') THEN string_split(t, ';') WHEN contains(t, '/') THEN regexp_split_to_array(t, '\\s*/\\s*') WHEN regexp_matches(t, '(?i)\\sor\\s') THEN regexp_split_to_array(t, '(?i)\\s+or\\s+')
 ELSE list_transform(string_split(regexp_replace(t, {quote(P.TAKEN)}, chr(1) || '\\1\\2', 'g'), ','), lambda x: replace(x, chr(1), ', ')) END"""


@query(
    "places_named",
    f"""WITH d AS (SELECT doc_id, {flat(_dealt_sql(TEXTS))} AS t FROM documents), lists AS (SELECT doc_id, list_filter(list_transform({_SPLIT}, lambda x: trim(x)), lambda x: x <> '') AS ps FROM d),
        parts AS (SELECT doc_id, n, ps[n] AS part FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM lists)), {_NAMES},
        one AS (SELECT doc_id, n, arg_min(place, (rank, place)) AS place FROM got WHERE place IS NOT NULL GROUP BY doc_id, n), firsts AS (SELECT doc_id, min((n, place)) AS f FROM one GROUP BY doc_id, lower(place))
        SELECT doc_id, string_agg(f[2], '; ' ORDER BY f) AS places FROM (SELECT doc_id, struct_pack(n := f[1], p := f[2]) AS f0, f FROM firsts) GROUP BY doc_id""",
)
def places_named(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", _dealt(TEXTS).alias("location"))
    return P.places(texts, "doc_id", "location", P.gazetteer(spark))


_ends = r"(?i)\s*\b(" + "|".join(P.ENDS) + r")\b.*$|\s*\((on-site|hybrid|remote)\).*$"


@query(
    "places_labelled",
    f"""WITH d AS (SELECT doc_id, {flat(f"coalesce(text, '') || ' ' || {_dealt_sql(LABELLED)}")} AS t FROM documents),
        ls AS (SELECT doc_id, t, regexp_extract_all(t, {quote(P.LABEL)}) AS ms, regexp_split_to_array(t, {quote(P.LABEL)}) AS gs FROM d), r AS (SELECT doc_id, t, k, ms[k] AS m, length(gs[k]) AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ls)),
        e AS (SELECT doc_id, t, m, k, CAST(sum(g + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e FROM r),
        w AS (SELECT doc_id, list_position([{', '.join(map(quote, P.LABELS))}], lower(m)) AS label, k AS start, list_slice(string_split(regexp_replace(ltrim(substring(t, e + 1, 160)), {quote(_ends)}, ''), ' '), 1, {P.WORDS}) AS ws FROM e),
        parts AS (SELECT doc_id, label, start, -n AS fewer, regexp_replace(array_to_string(ws[1:n], ' '), '[,;.:]+$', '') AS part FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS n FROM w WHERE ws[1] <> '')), {_NAMES}
        SELECT doc_id, arg_min(place, (label, start, fewer, rank, place)) AS place FROM got WHERE place IS NOT NULL GROUP BY doc_id""",
)
def places_labelled(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), _dealt(LABELLED)).alias("page"))
    return P.labelled_places(texts, "doc_id", "page", P.gazetteer(spark))
