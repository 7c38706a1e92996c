"""Requirements in descriptions: each document's text is a description, behind it a block of Markdown in turn."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import requirements as R
from harborline.functions import sections
from harborline.functions.text import mentions, once
from harborline.plans.registry import query
from harborline.plans.sql import flat as _flat
from harborline.plans.sql import quote as _quote
from harborline.sources.tables import table

BLOCKS = (
    "## Qualifications\n- Strong Excel, Word and MS Access skills\n- SQL Server and .NET; Python is an asset\n- Three (3) years of related experience",
    "## Nice to Have\n- Tableau and Power BI\n- Valid driver's licence\n- French\n\n**Skills:**\n- Microsoft Teams, C# and JavaScript.\n- Typing speed of 50-60 w.p.m.",
    "## Requirements\n- Valid class G driver's license\n- Bilingual in English and French\n- Minimum of 5 years experience in planning",
    "## Requirements\n* Access to a reliable vehicle is required\n* Standard First Aid with CPR-C and AED\n* 2 to 4 years of experience\n* Typing 40 words per minute",
    "LANGUAGE\nFluency in Spanish is required.\nSecurity Requirement: Reliability Status",
    "A driver license is not required.\n**Security Requirement:** None\nDriver's abstract must be provided",
    "## Education and training\n1. First aid or CPR level B\n2. Mental health first aid\n3. PeopleSoft / Workday\n4. 18 months experience\n- PeopleSoft / Workday",
    "## Qualifications\n- A vehicle for positions requiring travel\n- German, Italian\n- Access to a vehicle preferred\n- Emergency First Aid, CPR or AED\n- Emergency first aid cpr",
    "## Skills\n- Reports in Excel\n- Reports in excel and Word\n- At least one year of experience\n\n## Benefits\n- Typing 70 wpm\n- Defibrillator (AED) at work",
    "No vehicle needed; AED\nSecurity requirement: N/A\n## Skills\n- Standard or Intermediate First Aid\n- Ability to provide first aid\n- Ability to provide first aid; Standard First Aid, mental health training\n- Works with Word.",
)


def descriptions(spark, sf_dir: str) -> DataFrame:
    block = F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("doc_id") % len(BLOCKS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block).alias("description"))


_DESCRIPTIONS = f"SELECT doc_id, coalesce(text, '') || chr(10) || list_extract([{', '.join(map(_quote, BLOCKS))}], CAST(doc_id % {len(BLOCKS)} + 1 AS INTEGER)) AS description FROM documents"
_CASES = " ".join(f"WHEN regexp_matches(words, {_quote(pattern)}) THEN '{name}'" for name, pattern in sections.SECTIONS)
_LINES = f"""d AS ({_DESCRIPTIONS}), parts AS (SELECT doc_id, regexp_split_to_array(description, '\\r?\\n') AS p FROM d),
 raws AS (SELECT doc_id, i AS line, p[i + 1] AS raw FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM parts)),
 bares AS (SELECT *, {_flat('raw')} AS flat, regexp_replace(trim(raw), '^[#*\\s]+|[*:\\s]+$', '', 'g') AS bare FROM raws),
 heads AS (SELECT *, bare <> '' AND (regexp_matches(flat, '^#{{1,6}}\\s') OR (flat LIKE '*%' AND (flat LIKE '%*' OR flat LIKE '%*:') AND bare NOT LIKE '%*%' AND NOT regexp_matches(flat, '^\\*+\\s'))
   OR (regexp_matches(bare, '^[A-Z][A-Za-z0-9 &''/-]{{3,}}$') AND NOT regexp_matches(flat, '^[#*]') AND (flat LIKE '%:' OR bare = upper(bare)))) AS is_heading FROM bares),
 texts AS (SELECT doc_id, line, is_heading, CASE WHEN is_heading THEN lower({_flat('bare')}) ELSE {_flat("regexp_replace(raw, '^\\s*([-*•]|[0-9]+[.)])\\s+', '')")} END AS words FROM heads),
 named AS (SELECT *, CASE WHEN is_heading THEN CASE {_CASES} ELSE 'other' END END AS kind FROM texts WHERE words <> ''),
 lines AS (SELECT doc_id, CAST(line AS INTEGER) AS line, words AS text, is_heading, coalesce(last_value(kind IGNORE NULLS) OVER w, 'other') AS section, last_value(CASE WHEN is_heading THEN words END IGNORE NULLS) OVER w AS heading
   FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 needs AS (SELECT doc_id, line, text, section, heading, ' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[,;:()/]', ' , ', 'g'), '\\.([^a-z]|$)', ' , \\1', 'g'), '[^\\p{{L}}\\p{{N}},#.]+', ' ', 'g')) || ' , ' AS words FROM lines WHERE NOT is_heading)"""
_any = lambda phrases, c="words": "(" + " OR ".join(f"contains({c}, {_quote(f' {p} ')})" for p in phrases) + ")"
_names = lambda dictionary: "[" + ", ".join(f"CASE WHEN {_any(phrases)} THEN {_quote(name)} END" for name, phrases in dictionary) + "]"
_all = "coalesce(array_to_string(list_sort(list_distinct(flatten(list({0}) FILTER (WHERE {1})))), '; '), '')"


def _needs(spark, sf_dir: str) -> DataFrame:
    return R.requirement_lines(descriptions(spark, sf_dir), "doc_id", "description")


def _joined(values, where=None):
    """Distinct sorted values of a group's arrays; arrays come pre-aggregated from each partition."""
    rows = F.collect_set(values if where is None else F.when(where, values))
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(rows))), "; ")


@query("section_lines", f"WITH {_LINES} SELECT doc_id, line, md5(text) AS text_md5, is_heading, section FROM lines")
def section_lines(spark, sf_dir):
    return sections.lines(descriptions(spark, sf_dir), "doc_id", "description").select("doc_id", "line", F.md5("text").alias("text_md5"), "is_heading", "section")


_WANTED = "(" + " OR ".join(f"contains(heading, '{p}')" for p in R.SOFTWARE_HEADINGS) + ") AND NOT contains(heading, 'nice to have')"


@query(
    "software_required",
    f"""WITH {_LINES}, found AS (SELECT doc_id, {_any(R.OPTIONAL)} AS optional, list_filter({_names(R.SOFTWARE)} || [CASE WHEN regexp_matches(text, '\\bTeams\\b') THEN 'Microsoft Teams' END], lambda x: x IS NOT NULL) AS names FROM needs WHERE {_WANTED})
        SELECT doc_id, {_all.format('names', 'NOT optional')} AS software, count(*) FILTER (WHERE optional) AS skipped FROM found WHERE len(names) > 0 GROUP BY doc_id""",
)
def software_required(spark, sf_dir):
    """Software by document, and how many lines only wish for some."""
    lines = R.mentioning(_needs(spark, sf_dir).filter(R.on_qualifications(F.col("heading"))), R.SOFTWARE_STEMS)
    found = lines.select("doc_id", once(R.software(F.col("heading"), F.col("text"), F.col("words"))).alias("s")).select("doc_id", "s.names", "s.optional").filter(F.size("names") > 0)
    return found.groupBy("doc_id").agg(_joined(F.col("names"), ~F.col("optional")).alias("software"), F.count_if("optional").alias("skipped"))


_LABELLED = " OR ".join(f"starts_with(words, ' {p} , ')" for p in R.LANGUAGE_LABELS)


@query(
    "languages_required",
    f"""WITH {_LINES}, found AS (SELECT *, list_filter({_names(R.LANGUAGES)}, lambda x: x IS NOT NULL) AS names FROM needs WHERE section <> 'optional' AND NOT {_any(R.OPTIONAL)} AND (section = 'required' OR {_LABELLED} OR {_any(R.LANGUAGE_CUES)})),
        said AS (SELECT doc_id, CASE WHEN {_any(R.BILINGUAL)} OR (len(names) >= 2 AND {_any(R.PAIRED)}) THEN ['Bilingual'] ELSE names END AS names FROM found)
        SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(flatten(list(names))), lambda x: CASE x WHEN 'English' THEN '0' WHEN 'French' THEN '1' WHEN 'Bilingual' THEN '3' ELSE '2' END || x)), lambda x: x[2:]), '; ') AS languages
        FROM said WHERE len(names) > 0 GROUP BY doc_id""",
)
def languages_required(spark, sf_dir):
    lines = R.mentioning(_needs(spark, sf_dir), R.LANGUAGE_STEMS)
    found = lines.select("doc_id", once(R.languages(F.col("section"), F.col("words"))).alias("names")).filter(F.size("names") > 0)
    return found.groupBy("doc_id").agg(F.array_join(sections.languages(F.flatten(F.collect_set("names"))), "; ").alias("languages"))


_LICENCE = f"({_any(R.DRIVERS)} OR regexp_matches(words, ' class [a-z0-9]+ (driver |drivers |driver s |drivers s )?licen[cs]e '))"
_ABSTRACT = "(contains(words, ' driver abstract ') OR contains(words, ' drivers abstract ') OR contains(words, ' driver s abstract ')) AND NOT regexp_matches(words, ' (licence|license|permit|class [a-z0-9]+) ')"


@query(
    "vehicle_required",
    f"""WITH {_LINES}, said AS (SELECT doc_id, CASE
          WHEN ({_LICENCE} OR {_any(R.CAR)}) AND ({_any(R.NOT_NEEDED)} OR ({_any([f'no {x}' for x in (*R.DRIVERS, *R.CAR)])} AND {_any(R.NEEDED)})) THEN FALSE
          WHEN section <> 'optional' AND ({_LICENCE} OR {_any(R.OWN_CAR)}) AND (section = 'required' OR {_any(R.CAR_CUES)}) AND NOT ({_ABSTRACT}) AND NOT {_any(R.CONDITIONS)} AND NOT {_any(R.CAR_OPTIONAL)} THEN TRUE END AS said FROM needs)
        SELECT doc_id, bool_or(said) AS vehicle FROM said GROUP BY doc_id""",
)
def vehicle_required(spark, sf_dir):
    """True where any line requires one, else False where one says that none is needed, else null."""
    return _needs(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(R.vehicle(F.col("section"), F.col("words"))).alias("vehicle"))


@query(
    "security_required",
    f"""WITH {_LINES}, said AS (SELECT doc_id, line, trim(regexp_extract(lower(text), '^\\**security requirement:\\**\\s*(.+)$', 1)) AS v FROM lines)
        SELECT doc_id, NOT regexp_matches(arg_min(v, line), '^(none|not required|n/a)\\b') AS security FROM said WHERE v <> '' GROUP BY doc_id""",
)
def security_required(spark, sf_dir):
    """What the first line with the label says."""
    lines = _needs(spark, sf_dir).filter(mentions(F.col("text"), ("security requirement",)))
    said = lines.select("doc_id", "line", once(R.security_label(F.col("text"))).alias("said")).filter("said IS NOT NULL")
    return said.groupBy("doc_id").agg(F.min_by("said", "line").alias("security"))


_PLAIN = "' ' || lower(text) || ' '"
for _n, _name in enumerate(R.NUMBERS, 1):
    _PLAIN = f"regexp_replace({_PLAIN}, '\\b{_name}\\b', '{_n}', 'g')"
_PLAIN = f"regexp_replace({_PLAIN}, '\\b[0-9]+ ?\\(([0-9]+)\\)', '\\1', 'g')"
_YEARS = "'(minimum of |minimum |at least |over |more than )?\\b([0-9]+)(\\+?)(?: ?(?:-|–|—|to) ?([0-9]+))? ?(year|month|yr)'"


@query(
    "experience_required",
    f"""WITH {_LINES}, plain AS (SELECT doc_id, {_PLAIN} AS t FROM needs WHERE section NOT IN ('optional', 'benefits')),
        found AS (SELECT doc_id, regexp_extract(t, {_YEARS}, ['cue', 'low', 'plus', 'high', 'unit']) AS m FROM plain WHERE contains(t, 'experience') AND regexp_matches(t, {_YEARS}))
        SELECT doc_id, array_to_string(list_sort(list_distinct(list(CASE WHEN m.high <> '' THEN m.low || '–' || m.high || ' ' || u || 's' WHEN m.cue <> '' OR m.plus <> '' THEN m.low || '+ ' || u || 's' WHEN m.low = '1' THEN '1 ' || u ELSE m.low || ' ' || u || 's' END))), '; ') AS experience
        FROM (SELECT *, CASE m.unit WHEN 'month' THEN 'month' ELSE 'year' END AS u FROM found) GROUP BY doc_id""",
)
def experience_required(spark, sf_dir):
    lines = _needs(spark, sf_dir).filter("section NOT IN ('optional', 'benefits')").filter(mentions(F.col("text"), ("experience",)))
    found = lines.select("doc_id", once(R.experience(F.col("text"))).alias("x")).filter("x IS NOT NULL")
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("x")), "; ").alias("experience"))


@query(
    "typing_skills",
    f"""WITH {_LINES}, speeds AS (SELECT doc_id, regexp_extract(regexp_replace(lower(text), 'w\\.? ?p\\.? ?m\\b\\.?|words? per minute', 'wpm', 'g'), '\\b(?:typing|keyboarding|types?) (?:speed )?(?:of )?([0-9]+)(?: ?[-–—] ?([0-9]+))? ?wpm', ['low', 'high']) AS m FROM needs WHERE section NOT IN ('optional', 'benefits'))
        SELECT DISTINCT doc_id, 'Typing ' || m.low || CASE WHEN m.high <> '' THEN '–' || m.high ELSE '' END || ' w.p.m.' AS skill FROM speeds WHERE m.low <> ''""",
)
def typing_skills(spark, sf_dir):
    lines = _needs(spark, sf_dir).filter("section NOT IN ('optional', 'benefits')").filter(mentions(F.col("text"), ("typ", "keyboarding")))
    found = lines.select("doc_id", once(R.typing_speed(F.col("text"))).alias("skill"))
    return found.filter("skill IS NOT NULL").distinct()


_AID, _CPR, _AED = _any(("first aid", "firstaid")), _any(("cpr",)), "(contains(words, ' aed ') OR contains(words, 'defibrillator'))"
_LEVEL = f"""CASE WHEN ({_any(('standard first aid',))} AND {_any(('intermediate first aid',))}) OR {_any(('standard or intermediate first aid', 'intermediate , standard first aid'))} THEN 'Standard or Intermediate First Aid'
 {' '.join(f"WHEN {_any((f'{x.lower()} first aid',))} THEN '{x} First Aid'" for x in R.FIRST_AID_LEVELS)} WHEN {_AID} THEN 'First Aid' END"""
_GRADE = f"""CASE WHEN {_any(('cpr c', 'cpr level c', 'level c cpr', 'class c'))} THEN 'CPR-C' WHEN {_any(('cpr b', 'cpr level b', 'level b cpr'))} THEN 'CPR-B'
 WHEN {_any(('cpr a', 'cpr level a', 'level a cpr'))} THEN 'CPR-A' WHEN {_CPR} THEN 'CPR' END"""


@query(
    "first_aid_labels",
    f"""WITH {_LINES}, aids AS (SELECT doc_id, {_AID} AS aid, {_CPR} AS cpr, {_AED} AS aed, {_LEVEL} AS lv, {_GRADE} AS gr, {_any(R.EITHER_AED)} AS alt FROM needs
          WHERE ({_AID} OR {_CPR} OR {_AED}) AND section <> 'optional' AND NOT {_any(R.OPTIONAL)} AND NOT ({_AID} AND {_any(R.OTHER_FIRST_AID)}) AND NOT ({_any(('basic cardiac life support', 'bls'))} AND contains(words, ' or '))
          AND NOT ({_any([f'ability to {x} first aid' for x in ('provide', 'perform', 'administer')])} AND NOT {_CPR} AND NOT contains(words, 'certif') AND NOT {_any([f'{x.lower()} first aid' for x in R.FIRST_AID_LEVELS])}))
        SELECT doc_id, CASE WHEN lv IS NULL AND NOT cpr AND aed THEN 'AED' WHEN lv IS NULL THEN gr || CASE WHEN aed THEN '/AED' ELSE '' END
          WHEN gr IS NOT NULL THEN lv || ' with ' || gr || CASE WHEN aed AND alt THEN ' or AED' WHEN aed THEN '/AED' ELSE '' END WHEN aed THEN lv || ' with AED' ELSE lv END AS label FROM aids""",
)
def first_aid_labels(spark, sf_dir):
    lines = R.mentioning(_needs(spark, sf_dir).filter("section <> 'optional'"), R.FIRST_AID_STEMS)
    found = lines.select("doc_id", once(R.first_aid(F.col("words"))).alias("label"))
    return found.filter("label IS NOT NULL")


_BULLETS = r"^\s*([-*•]|[0-9]+[.)])\s+"


@query(
    "bullets_once",
    f"""WITH d AS ({_DESCRIPTIONS}), parts AS (SELECT doc_id, string_split(description, chr(10)) AS p FROM d), raws AS (SELECT doc_id, i, p[i + 1] AS raw FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM parts)),
        keyed AS (SELECT *, CASE WHEN regexp_matches(raw, '{_BULLETS}') THEN trim(regexp_replace(lower(regexp_replace(raw, '{_BULLETS}', '')), '[^a-z0-9]+', ' ', 'g')) END AS k FROM raws)
        SELECT doc_id, md5(string_agg(raw, chr(10) ORDER BY i)) AS digest, count(*) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM keyed) WHERE k IS NULL OR n = 1 GROUP BY doc_id""",
)
def bullets_once(spark, sf_dir):
    """Each description without bullets that repeat an earlier one."""
    kept = descriptions(spark, sf_dir).select("doc_id", sections.without_repeats(F.col("description")).alias("kept"))
    return kept.select("doc_id", F.md5("kept").alias("digest"), F.size(F.split("kept", "\n")).cast("long").alias("lines"))


@query(
    "narrower_bullets",
    f"""WITH {_LINES}, w AS (SELECT doc_id, line, section, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS ws FROM needs)
        SELECT doc_id, line FROM w a WHERE len(ws) >= 2 AND EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.section = a.section AND b.line <> a.line AND list_has_all(b.ws, a.ws) AND (len(b.ws) > len(a.ws) OR (len(b.ws) = len(a.ws) AND a.line > b.line)))""",
)
def narrower_bullets(spark, sf_dir):
    return sections.narrower_bullets(descriptions(spark, sf_dir), "doc_id", "description")
