"""Validation of captured rows: each order as a JSON object of loose values, by templates in turn."""
from pyspark.sql import functions as F

from harborline.functions import terms
from harborline.functions import validation as V
from harborline.functions.licences import DRIVER, TERMS
from harborline.functions.requirements import BILINGUAL, LANGUAGES
from harborline.plans.registry import query
from harborline.plans.sql import has_phrase, quote
from harborline.sources.tables import table

TAGS = ("data", "teamwork", "leadership")
TEMPLATES = (
    '{"job_title": "{name} clerk", "salary_min": "${price}", "salary_max": "$2,500.50", "salary_period": "per hour", "work_model": "Hybrid", "employment_type": "casual", "is_student": "yes", "required_skills": ["Excel", "Fluent French", "Excel", 7], "responsibility_tags": ["data", "magic"]}',
    '{"job_title": " {name}  analyst ", "salary_min": {price}, "salary_period": "each fortnight", "work_model": "at our office", "employment_type": "PT", "is_student": 0, "required_skills": "SQL, Valid driver\'s licence; Python", "license_requirements": ["P.Eng."], "benefits": ["Pension", "Pension"]}',
    '{"job_title": "{name} online tutor", "salary_min": "negotiable", "salary_max": "{price} a year", "salary_period": "annual", "work_model": "unknown", "employment_type": "Full time", "is_student": "maybe", "required_skills": ["Registered engineer", "Bilingual"], "license_requirements": "P.Eng.; RN", "responsibility_tags": {"data": 1}}',
    '{"job_title": "N/A", "salary_min": 1}',
    '["{name}", {price}]',
    '{"job_title": "{name}", "salary_min": {price}',
    '{"job_title": "{name} lead", "salary_min": null, "salary_max": "null", "salary_period": "", "required_skills": null, "benefits": ["Dental", "", "{name}"], "responsibility_tags": ["leadership", "data", "leadership"], "license_requirements": [], "is_student": "N/A"}',
)
_RAW = f"replace(replace(list_extract([{', '.join(map(quote, TEMPLATES))}], CAST(o_orderkey % {len(TEMPLATES)} + 1 AS INTEGER)), '{{name}}', c_mktsegment), '{{price}}', CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR))"
_g = lambda f: f"CASE WHEN json_type(j, '$.{f}') NOT IN ('ARRAY', 'OBJECT') THEN CASE WHEN trim(j->>'$.{f}') NOT IN ('', 'null', 'NULL', 'N/A') THEN trim(j->>'$.{f}') END END AS {f}_g"
_l = lambda f: f"""CASE json_type(j, '$.{f}') WHEN 'ARRAY' THEN list_filter(list_transform(list_filter(CAST(j->'$.{f}' AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(x->>'$')), lambda x: x <> '')
     WHEN 'VARCHAR' THEN list_filter(list_transform(regexp_split_to_array(j->>'$.{f}', '[,;]'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS {f}_v, CASE json_type(j, '$.{f}') WHEN 'ARRAY' THEN json_array_length(j, '$.{f}') WHEN 'VARCHAR' THEN len(list_filter(regexp_split_to_array(j->>'$.{f}', '[,;]'), lambda x: trim(x) <> '')) WHEN 'NULL' THEN 0 ELSE CASE WHEN json_type(j, '$.{f}') IS NULL THEN 0 ELSE 1 END END AS {f}_n"""  # noqa: E731
_once = lambda f: f"list_filter({f}_v, lambda x, i: list_position({f}_v, x) = i) AS {f}_o"
_words = r"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[,;:()/]', ' , ', 'g'), '\.([^a-z]|$)', ' , \1', 'g'), '[^\p{L}\p{N},#.]+', ' ', 'g')) || ' , '"
_number = lambda f: f"TRY_CAST(nullif(regexp_extract(regexp_replace({f}_g, '[$,\\s]', '', 'g'), '^[-+]?[0-9]*\\.?[0-9]+', 0), '') AS DOUBLE)"
_cases = lambda c, rules, default: "CASE " + " ".join(f"WHEN regexp_matches({c}, {quote(p)}) THEN '{v}'" for v, p in rules) + f" ELSE {default} END"
_packed = lambda c: f"regexp_replace(lower({c}), '[\\s_-]+', '', 'g')"
_parts = lambda c, parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_model = lambda weak: f"""CASE WHEN {_parts('wm', terms.HYBRID)} OR regexp_matches(lower(work_model_g), {quote(terms.HYBRID_PHRASES)}) THEN 'Hybrid' WHEN {_parts('wm', terms.REMOTE)} THEN 'Remote'
   WHEN regexp_matches(lower(job_title_g), {quote(terms.REMOTE_TITLE)}) THEN 'Remote' WHEN regexp_matches(lower(job_title_g), {quote(terms.HYBRID_TITLE)}) THEN 'Hybrid' {weak} END"""  # noqa: E731
_kinds = " ".join(f"WHEN {_parts('et', parts)}" + (" OR (contains(et, 'part') AND NOT contains(et, 'impart'))" if v == "Part-time" else "") + f" THEN '{v}'" for v, parts in terms.EMPLOYMENT)
_lists = ("required_skills", "license_requirements", "benefits", "responsibility_tags")
_flag = "CASE WHEN lower(is_student_g) IN ('1', 'true', 'yes', 'y', 'required') THEN 1 WHEN lower(is_student_g) IN ('0', 'false', 'no', 'n', 'not required', 'none') THEN 0 END"
_names = [p for _, phrases in LANGUAGES for p in phrases]
_SQL = f"""j0 AS (SELECT o_orderkey, {_RAW} AS raw FROM orders JOIN customer ON o_custkey = c_custkey),
 j1 AS (SELECT o_orderkey, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN CAST(raw AS JSON) END END AS j FROM j0),
 g AS (SELECT o_orderkey, j IS NOT NULL AS is_object, {', '.join(map(_g, ('job_title', 'salary_min', 'salary_max', 'salary_period', 'work_model', 'employment_type', 'is_student')))}, {', '.join(map(_l, _lists))} FROM j1),
 h AS (SELECT *, regexp_replace(lower(salary_period_g), '[\\s_-]+', ' ', 'g') AS sp, {_packed('work_model_g')} AS wm, {_packed('employment_type_g')} AS et, {', '.join(map(_once, _lists))} FROM g),
 k AS (SELECT *, regexp_replace(trim(job_title_g), '\\s+', ' ', 'g') AS job_title, {_number('salary_min')} AS salary_min, {_number('salary_max')} AS salary_max, {_flag} AS is_student,
   CASE WHEN sp IS NOT NULL THEN {_cases('sp', terms.PERIODS, "'yearly'")} END AS salary_period, {_cases('sp', terms.PERIODS, 'NULL')} AS sp_strict,
   CASE WHEN wm IS NOT NULL THEN {_model("ELSE 'On-site'")} END AS work_model, {_model("WHEN regexp_matches(wm, 'on-?site|inperson|office') THEN 'On-site'")} AS wm_strict,
   CASE WHEN et IS NOT NULL THEN CASE {_kinds} ELSE 'Full-time' END END AS employment_type, CASE {_kinds} WHEN contains(et, 'full') THEN 'Full-time' END AS et_strict,
   list_filter(required_skills_o, lambda x: NOT ({has_phrase(f'({_words})', BILINGUAL)} OR ({has_phrase(f'({_words})', _names)} AND {has_phrase(f'({_words})', V.PROFICIENCY)}) OR {has_phrase(f'({_words})', DRIVER)} OR (len(license_requirements_o) > 0 AND {has_phrase(f'({_words})', TERMS)}))) AS required_skills,
   license_requirements_o AS license_requirements, benefits_o AS benefits, list_filter(responsibility_tags_o, lambda x: x IN ({', '.join(map(quote, TAGS))})) AS responsibility_tags FROM h)"""
_scalar_issues = [f"SELECT o_orderkey, '{f}' AS field, 'unreadable' AS kind, 1 AS entries FROM k WHERE is_object AND job_title IS NOT NULL AND {f}_g IS NOT NULL AND {f} IS NULL" for f in ("salary_min", "salary_max", "is_student")]
_scalar_issues += [f"SELECT o_orderkey, '{f}', 'assumed', 1 FROM k WHERE is_object AND job_title IS NOT NULL AND {f}_g IS NOT NULL AND {s} IS NULL" for f, s in (("salary_period", "sp_strict"), ("work_model", "wm_strict"), ("employment_type", "et_strict"))]
_list_issues = [f"SELECT o_orderkey, '{f}', '{kind}', CAST({n} AS INTEGER) FROM k WHERE is_object AND job_title IS NOT NULL AND {n} > 0" for f in _lists for kind, n in (("unreadable", f"({f}_n - len({f}_v))"), ("repeated", f"(len({f}_v) - len({f}_o))"), ("refused", f"(len({f}_o) - len({f}))"))]
_ISSUES = " UNION ALL ".join(["SELECT o_orderkey, 'row' AS field, 'unreadable' AS kind, 1 AS entries FROM k WHERE NOT is_object", "SELECT o_orderkey, 'job_title', 'missing', 1 FROM k WHERE is_object AND job_title IS NULL", *_scalar_issues, "SELECT o_orderkey, 'salary_min', 'order', 1 FROM k WHERE job_title IS NOT NULL AND salary_min > salary_max", *_list_issues])
_SHOWN = ("job_title", "salary_min", "salary_max", "salary_period", "work_model", "employment_type", "is_student")


def _checked(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("o_orderkey") % len(TEMPLATES) + 1).cast("int"))
    text = F.replace(F.replace(template, F.lit("{name}"), F.col("c_mktsegment")), F.lit("{price}"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    raw = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", text.alias("captured"))
    return V.validated(raw, "o_orderkey", "captured", TAGS, F.lit("2026-01-01").cast("date"))


@query("validated_rows", f"WITH {_SQL} SELECT o_orderkey, {', '.join(_SHOWN)}, {', '.join(f'''array_to_string({f}, '; ') AS {f}''' for f in _lists)} FROM k WHERE is_object AND job_title IS NOT NULL")
def validated_rows(spark, sf_dir):
    """The accepted rows with their typed fields."""
    rows = V.accepted_rows(_checked(spark, sf_dir), "o_orderkey")
    return rows.select("o_orderkey", *_SHOWN, *(F.array_join(f, "; ").alias(f) for f in _lists))


@query("validation_issues", f"WITH {_SQL} {_ISSUES}")
def validation_issues(spark, sf_dir):
    """What was refused, repeated, unreadable, assumed or out of order, by row and field."""
    return V.issue_rows(_checked(spark, sf_dir), "o_orderkey").drop("accepted")


_kept = [f"SELECT '{f}' AS field, count({f}_g) AS given, count({f}) AS kept FROM ok" for f in _SHOWN] + [f"SELECT '{f}', coalesce(sum({f}_n), 0), coalesce(sum(len({f})), 0) FROM ok" for f in _lists]


@query("validation_counts", f"WITH {_SQL}, ok AS (SELECT * FROM k WHERE is_object AND job_title IS NOT NULL), c AS ({' UNION ALL '.join(_kept)}) SELECT field, CAST(given AS BIGINT) AS given, CAST(kept AS BIGINT) AS kept FROM c WHERE given > 0")
def validation_counts(spark, sf_dir):
    """Values that were given and kept, by field."""
    return V.field_counts(_checked(spark, sf_dir)).filter("given > 0")
