"""Descriptions against structured values: each document's text, a block of Markdown behind it, and the block's values."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import restatements as R
from harborline.functions import sections
from harborline.plans.registry import query
from harborline.plans.sql import flat as _flat
from harborline.plans.sql import has_phrase, plain
from harborline.plans.sql import quote as _quote
from harborline.sources.tables import table

BLOCKS = (
    ("## Qualifications\n- Strong Excel, Word and planning skills\n- Planning skills\n- Fluency in English and French\n\n## Duties\n- Use Excel", (("software", "Excel"), ("software", "Word"), ("language", "English"), ("language", "French"))),
    ("## Requirements\n- Valid Class G driver's license\n- Access to a reliable vehicle\n- Criminal record check\n- A nursing licence", (("vehicle", "Class G driver's licence"), ("security", "Criminal record check"))),
    ("## Experience required\n- Three (3) years of related experience\n- 5 years of experience in budgeting; 3 years experience\n- 18 months experience", (("experience", "3 years"), ("experience", "18 months"))),
    ("## Skills\n- Planning\n\n## Education and training\n- Completion of a university degree in Nursing\n- Diploma in accounting, planning\n- Proficiency in SAP", (("education", "Degree in nursing"), ("education", "Diploma in accounting"), ("software", "SAP"))),
    ("## Nice to Have\n- French is an asset\n- First Aid certificate and WHMIS training\n- CPR level C\n\n## Benefits\n- French lessons", (("language", "French"), ("certificate", "First Aid"), ("certificate", "CPR-C"))),
    ("**Skills:**\n- Typing speed of 60 wpm\n- Typing\n- typing.\n\nOther:\n* Typing", (("skill", "Typing 60 wpm"),)),
    ("## Language requirements\n- Bilingual in English and French\n- Languages other than English", (("language", "English"), ("language", "French"), ("language", "Bilingual"))),
    ("## Requirements\n- Registered Nurse in good standing with the college\n- Member of the bar\n- and", (("licence", "Registered Nurse"), ("unknown", "bar"))),
    ("## Qualifications\n- Excel", ()),
)


def blocks(spark, sf_dir: str) -> DataFrame:
    """(doc_id, description, values)."""
    one = lambda b: F.struct(F.lit(b[0]).alias("text"), (F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in b[1])) if b[1] else F.expr("CAST(array() AS array<struct<field:string,value:string>>)")).alias("values"))
    dealt = F.element_at(F.array(*map(one, BLOCKS)), (F.col("doc_id") % len(BLOCKS) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", dealt.alias("block"))
    return rows.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("block.text")).alias("description"), "block.values")


def _list(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]::VARCHAR[]"


_SAME = "MAP {" + ", ".join(f"{_quote(a)}: {_quote(b)}" for a, b in R.SAME.items()) + "}"
_tokens = lambda c: f"list_distinct(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9#]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: coalesce({_SAME}[w], w)))"
_GENERAL = _list(R.GENERAL)
_TOGETHER = _list([f for f, (_, t) in R.FIELDS.items() if t])
_AROUND = "CASE field " + " ".join(f"WHEN '{f}' THEN {_list(a)}" for f, (a, _) in R.FIELDS.items()) + " END"
_VALUES = ", ".join(f"({i}, {_quote(f)}, {_quote(v)})" for i, (_, values) in enumerate(BLOCKS) for f, v in values)
_BULLET = r"'^\s*([-*•]|[0-9]+[.)])\s+'"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower({_flat('bare')}), {_quote(p)}) THEN '{name}'" for name, p in sections.SECTIONS) + " ELSE 'other' END"


def _round(n: int) -> str:
    """The CTEs that lead from texts r{n} to r{n + 1}."""
    return f"""
 x{n} AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM r{n})),
 y{n} AS (SELECT doc_id, i, p[i] AS raw, regexp_matches(p[i], {_BULLET}) AS is_bullet FROM x{n}),
 k{n} AS (SELECT *, {_flat(f"regexp_replace(raw, {_BULLET}, '')")} AS body, {_flat('raw')} AS flat, regexp_replace(trim(raw), '^[#*\\s]+|[*:\\s]+$', '', 'g') AS bare FROM y{n}
   QUALIFY NOT is_bullet OR row_number() OVER (PARTITION BY doc_id, is_bullet, trim(regexp_replace(lower(regexp_replace(raw, {_BULLET}, '')), '[^a-z0-9]+', ' ', 'g')) ORDER BY i) = 1),
 m{n} AS (SELECT *, CASE WHEN bare <> '' AND (regexp_matches(flat, '^#{{1,6}}\\s') OR (flat LIKE '*%' AND (flat LIKE '%*' OR flat LIKE '%*:') AND bare NOT LIKE '%*%' AND NOT regexp_matches(flat, '^\\*+\\s'))
   OR (regexp_matches(bare, '^[A-Z][A-Za-z0-9 &''/-]{{3,}}$') AND NOT regexp_matches(flat, '^[#*]') AND (flat LIKE '%:' OR bare = upper(bare)))) THEN {_KIND} END AS mark FROM k{n}),
 s{n} AS (SELECT *, count(mark) OVER w AS section, last_value(mark IGNORE NULLS) OVER w AS kind FROM m{n} WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 c{n} AS (SELECT doc_id, i, unnest(range(1, len(cs) + 1)) AS j, cs FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(regexp_replace(body, '[.]+$', ''), '\\s*[;,]\\s*(and\\s+)?|\\s+and\\s+'), lambda c: c <> '') AS cs FROM s{n}
   WHERE mark IS NULL AND is_bullet AND kind IN ('required', 'optional') AND NOT {has_phrase(plain('body'), R.OPTIONAL)})),
 t{n} AS (SELECT doc_id, i, j, cs[j] AS clause, {_tokens('cs[j]')} AS ts FROM c{n}),
 u{n} AS (SELECT t.*, EXISTS (SELECT 1 FROM g WHERE g.doc_id = t.doc_id AND list_has_all(g.al, t.ts) AND list_has_any(g.core, t.ts)) AS covered, list_has_all(coalesce(f.idle, {_GENERAL}), t.ts) AS idle FROM t{n} t LEFT JOIN f USING (doc_id)),
 v{n} AS (SELECT doc_id, i, bool_or(covered) AS hit, string_agg(clause, ', ' ORDER BY j) FILTER (NOT covered AND NOT idle) AS rest FROM u{n} GROUP BY doc_id, i),
 w{n} AS (SELECT s.*, CASE WHEN coalesce(hit, FALSE) THEN regexp_extract(raw, {_BULLET}) || upper(rest[1]) || rest[2:] ELSE raw END AS now FROM s{n} s LEFT JOIN v{n} USING (doc_id, i)),
 z{n} AS (SELECT *, mark IS NULL OR bool_or(mark IS NULL AND trim(now) <> '') OVER (PARTITION BY doc_id, section) IS TRUE AS stays FROM w{n}),
 r{n + 1} AS (SELECT doc_id, CASE WHEN coalesce(string_agg(now, chr(10) ORDER BY i), '') = any_value(r.text) THEN any_value(r.text)
   ELSE regexp_replace(regexp_replace(coalesce(string_agg(now, chr(10) ORDER BY i) FILTER (stays), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END AS text FROM z{n} JOIN r{n} r USING (doc_id) GROUP BY doc_id)"""


_SQL = f"""WITH b AS (SELECT doc_id, CAST(doc_id % {len(BLOCKS)} AS INTEGER) AS block, coalesce(text, '') AS t FROM documents),
 r0 AS (SELECT doc_id, t || chr(10) || list_extract({_list(t for t, _ in BLOCKS)}, block + 1) AS text FROM b),
 given AS (SELECT doc_id, field, {_tokens('v')} AS ts, {_AROUND} AS around FROM b JOIN (VALUES {_VALUES}) AS x(block, field, v) USING (block) WHERE field IN {tuple(R.FIELDS)}),
 merged AS (SELECT doc_id, list_distinct(flatten(list(ts))) AS ts, any_value(around) AS around FROM given WHERE list_contains({_TOGETHER}, field) GROUP BY doc_id, field UNION ALL SELECT doc_id, ts, around FROM given WHERE NOT list_contains({_TOGETHER}, field)),
 g AS (SELECT doc_id, list_filter(ts, lambda x: NOT list_contains({_GENERAL}, x)) AS core, ts || {_GENERAL} || around AS al FROM merged),
 f AS (SELECT doc_id, {_GENERAL} || flatten(list(list_filter(al, lambda x: NOT list_contains(core, x)))) AS idle FROM g GROUP BY doc_id),{','.join(_round(n) for n in range(R.ROUNDS))}
SELECT doc_id, md5(text) AS digest, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM r{R.ROUNDS}"""


@query("restatements_removed", _SQL)
def restatements_removed(spark, sf_dir):
    """Each description without the bullets and clauses that its values restate."""
    kept = blocks(spark, sf_dir).select("doc_id", R.without_restatements(F.col("description"), F.col("values")).alias("text"))
    return kept.select("doc_id", F.md5("text").alias("digest"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
