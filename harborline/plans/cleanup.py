"""Cleaning of descriptions and small values; each document's text with Markdown behind it, in turn."""
from pyspark.sql import functions as F

from harborline.functions import cleanup as C
from harborline.plans.registry import query
from harborline.sources.tables import table

BLOCKS = (
    "## About\nWe build.\n\n## Benefits\n- None\n- N/A.\n## Nice to Have\n- French\n- Must be enrolled\n\n### Qualifications\n- Excel",
    "## Nice to Have\n- You are required to drive\nSome text that must be read\n## Pay\nNot specified.\n\n## Empty\n",
    "# Title\n\n## Nice to have\n- Eligible to work\n## Duties\n-  No additional duties\n- Sweep",
    "plain end ## no heading\n#no heading either\n## Other\nno additional information.\nnot required",
    "## Qualifications and skills\n- A\n## nice to have skills\n- Must be B\n- C\n- are required to D",
    "",
)
TAGS = ("Teaching", "Nursing", "IT")
VALUES = ('["nursing","IT","it","Cooking"]', "[", '{"a": 1}', '"x"', "  ", '[" Teaching "]', "[1, null]")
OPEN = ("Clerk (Part", "Clerk (Part)", "a) (b", "((x)", "none", ")(")


def _described(spark, sf_dir):
    block = F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("doc_id") % len(BLOCKS) + 1).cast("int"))
    described = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block).alias("text"))
    return described.select("doc_id", C.markdown_sections(F.col("text")).alias("sections"))


_quote = lambda x: "'" + x.replace("'", "''") + "'"
_pick = lambda values: f"list_extract([{', '.join(map(_quote, values))}], CAST(doc_id % {len(values)} + 1 AS INTEGER))"
_strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SECTIONS = f"""ds AS (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || {_pick(BLOCKS)}, chr(10)) AS p FROM documents),
 ls AS (SELECT doc_id, i, p[i + 1] AS x FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM ds)),
 ns AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^#{{1,3}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ls),
 hs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) = 1 AND regexp_matches(x, '^#{{1,3}}\\s+\\S') AS is_head FROM ns),
 gs AS (SELECT doc_id, n, coalesce(max({_strip("regexp_replace(x, '^#{1,3}\\s+', '')")}) FILTER (WHERE is_head), '') AS heading, {_strip("coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT is_head), '')")} AS body FROM hs GROUP BY doc_id, n),
 secs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, heading, body FROM gs WHERE heading <> '' OR body <> '')"""
_RENDER = "md5(coalesce(string_agg(CASE WHEN heading <> '' THEN '## ' || heading || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY pos), '')) AS digest, count(heading) AS sections"


@query("markdown_sections", f"WITH {_SECTIONS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, heading, md5(body) AS body_md5 FROM secs")
def markdown_sections(spark, sf_dir):
    return _described(spark, sf_dir).select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.heading", F.md5("s.body").alias("body_md5"))


_NOTHING = f"(lower(t) IN ({', '.join(map(_quote, C.NOTHING))}) OR starts_with(lower(t), {_quote(C.NOTHING_START)}))"


@query(
    "placeholder_sections_gone",
    f"""WITH {_SECTIONS}, said AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda l: regexp_replace({_strip("regexp_replace(l, '^\\s*[-•]\\s*', '')")}, '\\.$', '')), lambda l: l <> '') AS ts FROM secs),
        judged AS (SELECT *, heading <> '' AND len(list_filter(ts, lambda t: NOT {_NOTHING})) = 0 AS gone FROM said)
        SELECT d.doc_id, {_RENDER} FROM documents d LEFT JOIN (SELECT * FROM judged WHERE NOT gone) k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def placeholder_sections_gone(spark, sf_dir):
    kept = _described(spark, sf_dir).select("doc_id", C.without_placeholders(F.col("sections")).alias("s"))
    return kept.select("doc_id", F.md5(C.as_markdown(F.col("s"))).alias("digest"), F.size("s").cast("long").alias("sections"))


_MUST = "regexp_matches(x, '^\\s*[-•]\\s') AND (" + " OR ".join(f"contains(lower(x), '{p}')" for p in C.MANDATORY) + ")"


@query(
    "mandatory_wishes_moved",
    f"""WITH {_SECTIONS}, wish AS (SELECT *, contains(lower(heading), 'nice to have') AS nice FROM secs), wl AS (SELECT doc_id, pos, i, p[i + 1] AS x FROM (SELECT doc_id, pos, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, pos, string_split(body, chr(10)) AS p FROM wish WHERE nice))),
        mv AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos, i) AS moved FROM wl WHERE {_MUST} GROUP BY doc_id),
        stay AS (SELECT doc_id, pos, {_strip("string_agg(x, chr(10) ORDER BY i)")} AS body FROM wl WHERE NOT ({_MUST}) GROUP BY doc_id, pos),
        kept AS (SELECT doc_id, pos, heading, body FROM wish WHERE NOT nice UNION ALL SELECT w.doc_id, w.pos, heading, s.body FROM wish w JOIN stay s ON w.doc_id = s.doc_id AND w.pos = s.pos WHERE nice AND s.body <> ''),
        tgt AS (SELECT doc_id, min(pos) AS tp FROM kept WHERE contains(lower(heading), 'qualif') GROUP BY doc_id),
        full_ AS (SELECT k.doc_id, pos, heading, CASE WHEN pos = tp AND moved IS NOT NULL THEN {_strip("k.body || chr(10) || chr(10) || moved")} ELSE k.body END AS body FROM kept k LEFT JOIN tgt t ON k.doc_id = t.doc_id LEFT JOIN mv m ON k.doc_id = m.doc_id
          UNION ALL SELECT m.doc_id, 1000000000 AS pos, 'Qualifications' AS heading, moved AS body FROM mv m LEFT JOIN tgt t ON m.doc_id = t.doc_id WHERE tp IS NULL)
        SELECT d.doc_id, {_RENDER} FROM documents d LEFT JOIN full_ f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def mandatory_wishes_moved(spark, sf_dir):
    kept = _described(spark, sf_dir).select("doc_id", C.mandatory_wishes_moved(F.col("sections")).alias("s"))
    return kept.select("doc_id", F.md5(C.as_markdown(F.col("s"))).alias("digest"), F.size("s").cast("long").alias("sections"))


def _picked(spark, sf_dir, values):
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int")).alias("v"))


@query("open_parentheses", f"SELECT doc_id, length(regexp_replace(regexp_replace({_pick(OPEN)}, '^[^(]*', ''), '[^(]', '', 'g')) > length(regexp_replace(regexp_replace({_pick(OPEN)}, '^[^(]*', ''), '[^)]', '', 'g')) AS truncated FROM documents")
def open_parentheses(spark, sf_dir):
    return _picked(spark, sf_dir, OPEN).select("doc_id", C.open_parenthesis(F.col("v")).alias("truncated"))


_VALUE = f"(SELECT doc_id, {_pick(VALUES)} AS v FROM documents)"


@query("json_states", f"SELECT doc_id, CASE WHEN trim(v) = '' THEN 'empty' WHEN NOT json_valid(v) THEN 'malformed' WHEN json_type(v) = 'ARRAY' THEN 'array' ELSE 'other' END AS state FROM {_VALUE}")
def json_states(spark, sf_dir):
    return _picked(spark, sf_dir, VALUES).select("doc_id", C.json_state(F.col("v")).alias("state"))


@query("known_tags", f"SELECT doc_id, CASE CAST(doc_id % {len(VALUES)} AS INTEGER) WHEN 0 THEN 'Nursing|IT' WHEN 5 THEN 'Teaching' ELSE '' END AS tags FROM documents")
def known_tags(spark, sf_dir):
    from harborline.functions.text import json_strings

    return _picked(spark, sf_dir, VALUES).select("doc_id", F.array_join(C.known_tags(json_strings(F.col("v")), list(TAGS)), "|").alias("tags"))


@query("order_as_json", "SELECT o_orderkey, to_json({'key': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority})::VARCHAR AS js FROM orders")
def order_as_json(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("js"))


@query("source_names", "SELECT DISTINCT source, CASE source WHEN 'src0' THEN 'City Board' WHEN 'src1' THEN 'Province' ELSE upper(source) END AS shown FROM documents")
def source_names(spark, sf_dir):
    """A source's name from a small fixed map, its key in capitals without an entry."""
    names = F.create_map(*map(F.lit, ("src0", "City Board", "src1", "Province")))
    return table(spark, sf_dir, "documents").select("source", F.coalesce(F.try_element_at(names, F.col("source")), F.upper("source")).alias("shown")).distinct()
