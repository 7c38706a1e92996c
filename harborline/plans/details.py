"""Details of postings: each document's text, behind it requirements and labelled fields in turn, from which rows are read."""
from pyspark.sql import functions as F

from harborline.functions import details as T
from harborline.functions.requirements import NUMBERS
from harborline.functions.terms import NO_UNION, NO_UNION_START
from harborline.functions.text import once
from harborline.plans import education as E
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, plain, quote

TEXTS = (
    "job_title", "work_model", "employment_type", "start_date", "hours", "academic_role_type", "academic_course", "academic_workload", "academic_office_hours", "academic_supervisor", "academic_appointment_type", "academic_schedule",
    "union_name", "listing_type", "experience_requirements", "license_requirements", "benefits",
)
FLAGS = ("is_unionized", "is_inventory", "is_student", "vehicle_required")
BLOCKS = tuple(
    "\n".join(("## Qualifications", *education, "## Fields", *fields)) for education, fields in (
        (("- Grade 12", "- Bachelor's degree in Planning"), ("job_title: Teaching Assistant, Biology", "academic_course: Course code: BIO 101", "academic_workload: n/a", "hours: 10 hrs/wk", "is_unionized: 1", "union_name: CUPE 3902??", 'experience_requirements: ["Experience with reports", "Minimum of three years of planning", "5 years"]')),
        (("- PhD in Physics",), ("job_title: Sessional Instructor", "academic_role_type: postdoctoral", "academic_course: Fall 2026", "academic_workload: Workload - 0.5fte", "academic_office_hours: office hours: lab hours", "start_date: 2026-09-01T09:00", "is_unionized: 1", "union_name: Non-Union staff", "is_inventory: 1")),
        (("- Completion of two years of secondary school",), ("job_title: Clerk", "work_model: On-site", "academic_supervisor: PI: Dr. Ng", "academic_appointment_type: appointment type: tenure track", "is_unionized: 1", "union_name: Union", "listing_type: ongoing_recruitment", "is_inventory: 1", 'experience_requirements: ["two years part-time or one year full-time", "recent experience is defined as two years or more within the past five (5) years"]', "Eligible for Future Requirements")),
        (("- Degree in law",), ("job_title: Post-Doc Fellow", "employment_type: Contract", "academic_appointment_type: Full-time", "academic_office_hours: Consultation hours: 2 hrs per wk", "start_date: 2026-02-30", "union_name: CUPE", 'license_requirements: ["Class G", "", 5, "P.Eng."]', "experience_requirements: [1, ", "is_student: 1")),
        ((), ("academic_schedule: Mon – Wed", "start_date:  as soon as possible", "listing_type: inventory", 'experience_requirements: ["is defined as such", "Experience in the field.", "2 to 4 years of work", "Several years", "experience: lab work;"]', 'benefits: ["Dental", "Pension"]', "vehicle_required: 1", "is_unionized: 0", "union_name: USW")),
        (("- Diploma in Art",), ("job_title: Course Coordinator", "academic_workload: temporary", "hours: appointment: 12 hours / week", "academic_course: Project: Rivers", "academic_supervisor: unknown", "is_unionized: 1", 'experience_requirements: {"a": 1}', "vehicle_required: 0")),
    )
)

_MINE = E.described(BLOCKS)
_field = lambda name: f"nullif(regexp_extract(description, '(?m)^{name}: (.*)$', 1), '')"
_strings = lambda c: f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'ARRAY' THEN list_transform(list_filter(CAST({c} AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') END END"
_listed = lambda c: f"nullif(array_to_string(list_filter({_strings(c)}, lambda x: x <> ''), ', '), '')"


def _swapped(x, pairs):
    for pattern, by in pairs:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"
    return flat(x)


_digits = lambda c: f"CASE lower({c}) " + " ".join(f"WHEN '{n}' THEN '{i}'" for i, n in enumerate(NUMBERS, 1)) + f" ELSE {c} END"
_in = lambda c, values: f"lower({c}) IN ({', '.join(map(quote, values))})"


def _academic(column, field):
    """SQL of a field on an academic post."""
    tidy = f"regexp_replace({flat(column)}, '[–—]', '-', 'g')"
    bare = f"CASE WHEN {tidy} <> '' AND NOT {_in(tidy, T.PLACEHOLDERS)} THEN {tidy} END"
    if T.LABELS[field]:
        bare = f"trim(regexp_replace({bare}, {quote(T.label_pattern(field))}, '', 'g'))"
    if field in ("workload", "office_hours"):
        bare = _swapped(bare, T.UNITS if field == "workload" else T.UNITS[:3])
    if field == "appointment_type":
        bare = f"list_transform([{_swapped(bare, T.TENURES)}], lambda s: upper(s[1:1]) || s[2:])[1]"
    empty = {"course": f"regexp_matches(b, {quote(T.TERM)})", "workload": _in("b", T.GENERIC), "appointment_type": _in("b", T.GENERIC), "office_hours": _in("b", T.ONLY_HOURS)}.get(field, "FALSE")
    return f"list_transform([{bare}], lambda b: CASE WHEN b <> '' AND NOT {empty} THEN b END)[1]"


_title = plain("job_title")
_stored_role = " ".join(f"WHEN {quote(key)} THEN {quote(label)}" for key, label, _ in T.ROLES)
_title_role = " ".join(f"WHEN {has_phrase(_title, words)} THEN {quote(label)}" for _, label, words in T.ROLES)
_role = f"coalesce(CASE academic_role_type {_stored_role} END, CASE {_title_role} END)"
_SQL = f"""WITH {E.found_sql(_MINE)},
 learnt AS (SELECT doc_id, string_agg(label, ', ' ORDER BY line) AS education FROM kept GROUP BY doc_id),
 r AS (SELECT doc_id, description, {', '.join(f'{_field(x)} AS {x}' for x in TEXTS)}, {', '.join(f'try_cast({_field(x)} AS INTEGER) AS {x}' for x in FLAGS)} FROM d),
 x0 AS (SELECT doc_id, k, {flat('vs[k]')} AS s FROM (SELECT doc_id, vs, unnest(range(1, len(vs) + 1)) AS k FROM (SELECT doc_id, {_strings('experience_requirements')} AS vs FROM r))),
 x1 AS (SELECT *, regexp_extract(s, {quote(T.LEAD)}, 1) AS low, regexp_extract(s, {quote(T.LEAD)}, 2) AS high, regexp_extract(s, {quote(f"(?i)^({'|'.join(NUMBERS)}) years?{chr(92)}b")}, 1) AS named, regexp_extract(s, {quote(T.WITHIN)}, 1) AS recent, regexp_extract(s, {quote(T.OR_MORE)}, 1) AS more FROM x0),
 x2 AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)\\bor\\b') THEN CASE WHEN named <> '' THEN {_digits('named')} || s[length(named) + 1:] ELSE s END
   WHEN low <> '' THEN {_digits('low')} || CASE WHEN high <> '' THEN '–' || {_digits('high')} ELSE '+' END || ' years' || regexp_replace(s, {quote(T.LEAD)}, '') ELSE s END AS led FROM x1),
 x3 AS (SELECT *, trim(regexp_replace(regexp_replace(led || ' ', {quote(T.OPENINGS)}, ''), '[.;\\s]+$', '')) AS short FROM x2),
 x4 AS (SELECT doc_id, k, regexp_matches(s, '(?i)\\bis defined as\\b') AS defined, CASE WHEN s = '' OR regexp_matches(s, {quote(T.FINISHED)}) THEN s
   WHEN regexp_matches(s, {quote(T.DEFINED)}) THEN CASE WHEN recent <> '' THEN 'Recent (within past ' || recent || ' years)' WHEN more <> '' THEN {_digits('more')} || '+ years' ELSE '' END ELSE upper(short[1:1]) || short[2:] END AS label FROM x3),
 x5 AS (SELECT *, defined OR regexp_matches(label, {quote(T.DURATION)}) AS span FROM x4 WHERE label <> ''),
 x6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, span ORDER BY k) AS nth FROM x5),
 xs AS (SELECT doc_id, string_agg(label, '; ' ORDER BY span DESC, k) AS experience FROM x6 WHERE NOT span OR nth = 1 GROUP BY doc_id),
 u AS (SELECT doc_id, {flat("regexp_replace(trim(union_name), '[?]+$', '', 'g')")} AS s FROM r WHERE is_unionized = 1),
 us AS (SELECT doc_id, CASE WHEN lower(s) = 'union' THEN 'Unionized' ELSE s END AS union_shown FROM u WHERE s <> '' AND trim({plain('s')}) NOT IN ({', '.join(map(quote, NO_UNION))}) AND NOT ({' OR '.join(f"starts_with({plain('s')}, {quote(f' {p} ')})" for p in NO_UNION_START)}))
SELECT r.doc_id, CASE work_model WHEN 'On-site' THEN 'In-person' ELSE work_model END AS mode, employment_type AS type, CASE WHEN try_cast(trim(start_date)[:10] AS DATE) IS NOT NULL THEN strftime(try_cast(trim(start_date)[:10] AS DATE), '%b %-d, %Y') ELSE nullif(trim(start_date), '') END AS start_date, hours,
 {_role} AS role, coalesce({_academic('academic_workload', 'workload')}, {_academic('hours', 'workload')}) AS workload, {', '.join(f"{_academic(f'academic_{f}', f)} AS {f}" for f in T.LABELS if f != 'workload')}, union_shown AS union_name,
 CASE WHEN listing_type = 'ongoing_recruitment' THEN 'Ongoing recruitment' WHEN listing_type = 'inventory' OR is_inventory = 1 THEN 'Candidate inventory' END AS listing, CASE is_student WHEN 1 THEN 'Yes' END AS student,
 experience, education, {_listed('license_requirements')} AS licences, CASE vehicle_required WHEN 1 THEN 'Required' END AS vehicle, {_listed('benefits')} AS benefits, CASE WHEN contains(lower(description), 'future requirements') THEN 'Eligible for future requirements' END AS future
FROM r LEFT JOIN learnt USING (doc_id) LEFT JOIN xs USING (doc_id) LEFT JOIN us USING (doc_id)"""


def rows(spark, sf_dir):
    """A stored row for each text: labelled fields as they stand, education from the lines that require it."""
    texts = E.descriptions(spark, sf_dir, BLOCKS)
    labelled = F.filter(F.split("description", r"\r\n|[\n\r\x{0085}\x{2028}\x{2029}]"), lambda x: x.rlike(f"^(?:{'|'.join((*TEXTS, *FLAGS))}): "))
    field = lambda name: F.nullif(F.regexp_extract("labelled", f"(?m)^{name}: (.*)$", 1), F.lit(""))
    absent = ("duration", "availability", "salary_period", "language_requirements", "certification_requirements", "software_requirements", "medical_requirements", "required_skills")
    stored = texts.withColumn("labelled", once(F.array_join(labelled, "\n"))).select("doc_id", "description", *(field(x).alias(x) for x in TEXTS), *(field(x).try_cast("int").alias(x) for x in FLAGS), F.lit(None).cast("int").alias("security_check_required"), F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), *(F.lit(None).cast("string").alias(x) for x in absent))
    return stored.join(E.required(texts).select("doc_id", F.to_json("labels").alias("education_requirements")), "doc_id", "left")


@query("posting_details", _SQL)
def posting_details(spark, sf_dir):
    d = rows(spark, sf_dir).select("doc_id", T.details().alias("d"))
    return d.select(
        "doc_id", *(f"d.{x}" for x in ("mode", "type", "start_date", "hours")), "d.academic.*", F.col("d.union").alias("union_name"), "d.listing", "d.student", *(f"d.requirements.{x}" for x in ("experience", "education", "licences", "vehicle")), "d.benefits", "d.future"
    )
