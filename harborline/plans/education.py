"""Education: each document's text, and behind it a block of requirements in turn."""
from pyspark.sql import functions as F

from harborline.functions import education as E
from harborline.functions.requirements import requirement_lines
from harborline.functions.text import once
from harborline.plans import descriptions as D
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, quote
from harborline.sources.tables import table

BLOCKS = (
    "## Qualifications\n- Grade 12 or equivalent\n- Bachelor's degree in Planning with at least five years of related experience\n- Must produce verification of degree(s) at interview",
    "## Requirements\n- AS-01 only:- Successful completion of a post-secondary diploma or degree in a law related field (already obtained OR obtained before appointment)\n- PhD in a relevant discipline",
    "## Requirements\n* Master's degree is preferred\n* Master Electrician certification\n* Advanced college diploma (3 years) in Forestry or equivalent\n* Completion of two years of secondary school",
    "## Education\nED1: Graduation with a degree from a recognized post-secondary institution in mechanical engineering\nUndergraduate degree\nBachelor of Law (LL.B) and must hold a valid licence",
    "## Nice to Have\n- Master's degree\n\n## Duties\n- Reports on the degree program\n- Minimum of a college diploma in Nursing or an acceptable combination of education and experience is required",
    "## Skills\n- Familiarity with degree programs\n- High school graduation, plus a program in Law and Security\n- Current enrolment as a full-time student\n- Strong writing; a high degree of care",
    "## Qualifications\n- Bachelor's degree in Communications, Media, or related field (Master's preferred)\n- Secondary school diploma and Personal Support Worker certificate\n- High school diploma\n- bachelor's",
)


def descriptions(spark, sf_dir, blocks=BLOCKS):
    block = F.element_at(F.array(*map(F.lit, blocks)), (F.col("doc_id") % len(blocks) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block).alias("description"))


def _steps(x, steps):
    for pattern, by in steps:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"
    return flat(x)


_words = lambda c: rf"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[,;:()/]', ' , ', 'g'), '\.([^a-z]|$)', ' , \1', 'g'), '[^\p{{L}}\p{{N}},#.]+', ' ', 'g')) || ' , '"
_begins = lambda phrases: "(" + " OR ".join(f"starts_with(w, {quote(f' {p} ')})" for p in phrases) + ")"
_school, _known = E.LEVELS[0][2] + E.LEVELS[1][2], [p for _, _, phrases in E.LEVELS for p in phrases]
_hit = [(has_phrase("v", phrases), E.suffices()[name]) for name, _, phrases in E.LEVELS]
_any_of = " | ".join(f"CASE WHEN {h} THEN {bits} ELSE 0 END" for h, bits in _hit)
_all_of = " & ".join(f"CASE WHEN {h} THEN {bits} ELSE -1 END" for h, bits in _hit)
_proof = f"({has_phrase('v', E.VERIFICATION)} OR contains(v, ' education verification '))"


def described(blocks) -> str:
    """SQL of the documents' texts with one of the blocks behind each."""
    return f"SELECT doc_id, coalesce(text, '') || chr(10) || list_extract([{', '.join(map(quote, blocks))}], CAST(doc_id % {len(blocks)} + 1 AS INTEGER)) AS description FROM documents"


def found_sql(described_sql: str) -> str:
    """The steps up to the labels that are kept, (doc_id, label, line), of descriptions given as SQL."""
    return f"{D._LINES.replace(D._DESCRIPTIONS, described_sql)},{_FOUND}"


_FOUND = f"""
 e0 AS (SELECT doc_id, line, section, {_steps('text', E.ASIDES)} AS t FROM needs WHERE section NOT IN ('optional', 'benefits')),
 e1 AS (SELECT *, {_words('t')} AS w, {_words(f"regexp_replace(t, {quote(E.SCHOOL_DIPLOMA)}, '{chr(92)}1 school', 'g')")} AS v FROM e0),
 e2 AS (SELECT * FROM e1 WHERE {has_phrase('w', E.VERIFICATION)} OR ({has_phrase('w', _known)}
   AND (section = 'required' OR (length(t) <= 300 AND ({has_phrase('w', _school)} OR ({_begins(E.STARTS)} AND ({has_phrase('w', E.CUES)} OR {has_phrase('w', E.LEVELS[3][2])})))))
   AND NOT ({_begins(E.KNOWLEDGE)} AND NOT {has_phrase('w', E.FORMAL)} AND NOT {has_phrase('w', _school)}) AND NOT {has_phrase('w', (*E.WISHES, *E.OTHER))})),
 e3 AS (SELECT *, {_proof} AS proof, {has_phrase('v', _school)} AS school, {_steps('t', E.STEPS)} AS s, lower(regexp_extract(t, {quote(E.SCHOOL_YEARS)}, 1)) AS n,
   regexp_replace(regexp_extract(regexp_replace(t, '(?i),? or equivalent[.;, ]*$', '', 'g'), {quote(E.FIELD)}, 1), '[.;, ]+$', '', 'g') AS f, {_any_of} AS either, {_all_of} AS every FROM e2),
 e4 AS (SELECT *, upper(s[1:1]) || s[2:] AS p, CASE n WHEN '' THEN NULL {' '.join(f"WHEN '{x}' THEN '{i}'" for i, x in enumerate(E.YEARS, 1))} ELSE n END AS years FROM e3),
 e5 AS (SELECT doc_id, line, CASE WHEN proof THEN 'Education verification'
   WHEN school THEN CASE WHEN regexp_matches(t, {quote(E.PLUS_PROGRAM)}) THEN CASE WHEN f = '' THEN 'High school diploma plus related program' ELSE 'High school diploma plus program in ' || f END
     WHEN years IS NOT NULL THEN years || CASE years WHEN '1' THEN ' year' ELSE ' years' END || ' of high school' WHEN {has_phrase('v', E.LEVELS[0][2][:2])} THEN 'Partial high school'
     WHEN contains(v, ' personal support worker ') THEN 'High school diploma and Personal Support Worker certificate' ELSE 'High school diploma' END
   WHEN length(p) > 160 AND length(trim(string_split_regex(p, '[.;]')[1])) >= 12 THEN trim(string_split_regex(p, '[.;]')[1]) ELSE p END AS label,
   CASE WHEN proof THEN 0 WHEN school THEN CASE WHEN contains(v, ' year') OR {has_phrase('v', E.LEVELS[0][2])} THEN {E.suffices()['some_high_school']} ELSE {E.suffices()['high_school']} END
     WHEN either = 0 THEN 0 WHEN contains(v, ' or ') OR contains(v, ' , ') THEN either ELSE every END AS bits FROM e4),
 found AS (SELECT *, lower(regexp_extract(label, {quote(E.FIELD)}, 1)) AS field FROM e5 WHERE label <> ''),
 kept AS (SELECT doc_id, label, min(line) AS line FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.doc_id = x.doc_id AND y.bits <> 0 AND y.bits & x.bits = y.bits
   AND (y.bits <> x.bits OR (x.field = '' AND y.field <> '')) AND (x.field = '' OR x.field = y.field)) GROUP BY doc_id, label)"""
FOUND = found_sql(described(BLOCKS))


def required(texts):
    """(doc_id, lines, labels): how many lines require education, and the labels that no other one implies, in order."""
    lines = requirement_lines(texts, "doc_id", "description")
    found = lines.select("doc_id", "line", once(E.education(F.col("section"), F.col("text"))).alias("e")).filter("e.label <> ''")
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "e"))).alias("rows"))
    return rows.select("doc_id", F.size("rows").cast("long").alias("lines"), E.without_implied(F.transform("rows", lambda r: r["e"])).alias("labels"))


@query("education_required", f"WITH {FOUND} SELECT k.doc_id, n.lines, string_agg(label, '; ' ORDER BY line) AS education FROM kept k JOIN (SELECT doc_id, count(*) AS lines FROM found GROUP BY doc_id) n USING (doc_id) GROUP BY k.doc_id, n.lines")
def education_required(spark, sf_dir):
    return required(descriptions(spark, sf_dir)).select("doc_id", "lines", F.array_join("labels", "; ").alias("education"))


_SHOWN = "SELECT doc_id, lower(string_agg(label, ' ' ORDER BY line)) AS t FROM kept GROUP BY doc_id"
_matched = ", ".join(f"regexp_matches(t, {quote(pattern)}) AS {level}" for level, pattern in E.LEVEL_WORDS)


@query("education_filters", f"WITH {FOUND}, shown AS ({_SHOWN}) SELECT doc_id, {_matched}, contains(t, 'law') AS in_field FROM shown")
def education_filters(spark, sf_dir):
    """Which level filters each posting passes; the values are JSON arrays, JSON objects and plain text in turn."""
    rows = required(descriptions(spark, sf_dir))
    as_object = F.to_json(F.map_from_arrays(F.transform("labels", lambda x, i: F.format_string("%05d", i)), "labels"))
    value = F.when(F.col("doc_id") % 3 == 0, F.to_json("labels")).when(F.col("doc_id") % 3 == 1, as_object).otherwise(F.array_join("labels", " "))
    shown = rows.select("doc_id", value.alias("v"))
    return shown.select("doc_id", *(E.matches_level(F.col("v"), level).alias(level) for level, _ in E.LEVEL_WORDS), E.matches_field(F.col("v"), " LAW ").alias("in_field"))
