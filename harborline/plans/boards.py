"""Captures of boards: each document's text, and behind it what a board's page says."""
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import terms
from harborline.operators import boards as B
from harborline.plans.registry import query
from harborline.plans.sql import flat as _flat
from harborline.plans.sql import plain as _plain
from harborline.plans.sql import quote as _quote
from harborline.sources.tables import table

AS_OF = dt.date(2026, 1, 1)
PAGES = (
    ("hamilton", "Union: CUPE Local 5167\nDuration: 12 months\nClose date: applications by 4 pm on March 3, 2026\nThis is a Hybrid role"),
    ("hamilton", "Union: Non-Union\nClose date: none"),
    ("toronto", "Division & Section: Parks - North\nWork Location: City Hall\nJob Type & Duration: Temporary, 18 months\nSalary Range: $80,000.00 - $95,500.50 per year\nShift Information: 35 hours per week\nAffiliation: L79 Full-time\nPosting Period: 2026-02-01 to 2026-02-20"),
    ("workday", "Department: Library\nHiring Range: $30.25 to $38.10 an hour\nTerm: N/A\nLength of Contract:\n6 months\nPosting Closing Date: April 9, 2026"),
    ("icims", "Status: Part-Time\nLocation: London\nHourly wage (full range): $25.00\nMembers of ONA"),
    ("adp", "Department and Commission: Transit\nVacancy Type: Temporary Full Time\nApplication Deadline: soon\nApplication Deadline: May 1, 2026"),
    ("dayforce", "Rate of Pay: $50,000\nEmployment type: Permanent\nHours of work: 40\nBusiness unit: Roads\nDivision: Works"),
    ("njoyn", "Base Salary: $1,000 monthly\nJD#:\nCasual\nUnion: TBD\nVacancy Type: Permanent"),
    ("taleo", "Department\nFinance\nPay Range\n$60,000 - $70,000\nJob Details\nSeasonal\nClosing Date\n2026-06-30"),
    ("successfactors", "Department / Unit: Nursing\nSite: Main\nCity: Ottawa\nWork Arrangement: Work from home\nPosting End Date: July 7, 2026"),
    ("technomedia", "Department/Faculty (BU)\nScience\nAffiliation *\nYUSA\nCompensation\n$40.00\nTotal Weekly Hours of Work\n35"),
    ("jobs2web", "Rate of Pay: $22.10\nJob Closing Date (yyyy-mm-dd): 2026-08-01"),
    ("canada", "Closing date:\nAugust 31, 2026\nSalary\n$70,100 to $80,200\nLocation\nVarious"),
    ("peoplesoft", "Department: Engineering\nBargaining Unit: Faculty Association\nClosing Date: 2026-09-09"),
    ("elsewhere", "Department: Engineering"),
    (None, "Department: Engineering"),
)


def captures(spark, sf_dir: str) -> DataFrame:
    page = F.element_at(F.array(*(F.struct(F.lit(b).cast("string").alias("board"), F.lit(t).alias("text")) for b, t in PAGES)), (F.col("doc_id") % len(PAGES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", page.alias("page"))
    return rows.select("doc_id", "page.board", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("page.text")).alias("text"))


_lit = lambda x: "NULL" if x is None else _quote(x) if isinstance(x, str) else str(x)
_PAGES = ", ".join(f"({i}, {_lit(b)}, {_lit(t)})" for i, (b, t) in enumerate(PAGES))
_RULES = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in B.RULES)
_words = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_label = lambda x: "coalesce(nullif(" + _words(rf"regexp_replace({x}, '\([^)]*\)', ' ', 'g')") + ", ''), " + _words(x) + ")"
_packed = "regexp_replace(lower(value), '[\\s_-]+', '', 'g')"
_PART = f"(contains({_packed}, 'part') AND NOT contains({_packed}, 'impart'))"
_hit = lambda name, parts: " OR ".join([f"contains({_packed}, {_quote(p)})" for p in parts] + [_PART] * (name == "Part-time"))
_EMPLOYMENT = "CASE " + " ".join(f"WHEN {_hit(name, parts)} THEN '{name}'" for name, parts in terms.EMPLOYMENT) + " ELSE 'Full-time' END"
_PERIOD = "CASE " + " ".join(f"WHEN regexp_matches(regexp_replace(lower(value), '[\\s_-]+', ' ', 'g'), {_quote(p)}) THEN '{name}'" for name, p in terms.PERIODS) + " ELSE 'yearly' END"
_AMOUNTS = "list_transform(regexp_extract_all(value, '\\$([0-9]{1,3}(,[0-9]{3})*(\\.[0-9]{1,4})?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"
_DATES = "list_filter(list_transform(regexp_extract_all(value, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}'), lambda x: coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%B %d, %Y'))), lambda x: x IS NOT NULL)"
_day = lambda i: f"strftime(({_DATES})[{i}], '%Y-%m-%d')"
_NONE = f"{_plain('value')} IN (' n a ', ' none ')"
_starts = " OR ".join(f"starts_with({_plain('value')}, {_quote(f' {p} ')})" for p in terms.NO_UNION_START)
_DENIED = f"(trim({_plain('value')}) IN ({', '.join(map(_quote, terms.NO_UNION))}) OR {_starts})"
_SQL = f"""WITH pages AS (SELECT * FROM (VALUES {_PAGES}) AS t(n, board, page)), rules AS (SELECT * FROM (VALUES {_RULES}) AS t(board, field, kind, label, format, constant, rank)),
 c AS (SELECT doc_id, board, coalesce(text, '') || chr(10) || page AS text FROM documents JOIN pages ON doc_id % {len(PAGES)} = n),
 l AS (SELECT doc_id, board, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {_flat('x')}), lambda x: x <> '') AS ls FROM c),
 e AS (SELECT doc_id, board, i, ls[i] AS raw, ls[i + 1] AS following FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
 p AS (SELECT doc_id, board, i, CASE WHEN regexp_matches(raw, '^[^:]{{1,{B.LABEL_LENGTH}}}:') THEN regexp_extract(raw, '^([^:]+):', 1) WHEN length(raw) <= {B.LABEL_LENGTH} THEN raw END AS name,
   coalesce(CASE WHEN regexp_matches(raw, '^[^:]{{1,{B.LABEL_LENGTH}}}:') THEN nullif(trim(regexp_replace(raw, '^[^:]+:', '')), '') END, following) AS value FROM e),
 named AS (SELECT doc_id, board, i, value, {_label('name')} AS k FROM p WHERE name IS NOT NULL AND value IS NOT NULL),
 hits AS (SELECT doc_id, r.board, field, rank, i, format, value FROM named n JOIN (SELECT *, {_label('label')} AS rk FROM rules WHERE kind = 'label') r ON n.board = r.board AND (k = rk OR ends_with(k, ' ' || rk))),
 made AS (SELECT doc_id, board, field, rank, i, CASE format WHEN 'text' THEN CASE WHEN NOT {_NONE} THEN value END WHEN 'department' THEN nullif(regexp_replace(value, '\\s*[-–—]\\s.*', ''), '') WHEN 'employment' THEN {_EMPLOYMENT} WHEN 'contract' THEN CASE WHEN NOT {_NONE} THEN 'Contract' END
   WHEN 'model' THEN CASE WHEN contains({_packed}, 'workfromhome') THEN 'Remote' ELSE 'On-site' END WHEN 'length' THEN CASE WHEN contains({_plain('value')}, ' permanent ') THEN 'Permanent' ELSE coalesce(nullif(regexp_extract(value, '(?i)[0-9]+ (month|year)s?|temporary'), ''), 'Contract') END
   WHEN 'low' THEN printf('%.2f', ({_AMOUNTS})[1]) WHEN 'high' THEN printf('%.2f', ({_AMOUNTS})[-1]) WHEN 'period' THEN {_PERIOD} WHEN 'union' THEN CASE WHEN {_DENIED} THEN '' ELSE value END WHEN 'member' THEN CASE WHEN {_DENIED} THEN 'false' ELSE 'true' END
   WHEN 'date' THEN {_day(1)} WHEN 'last_date' THEN {_day(-1)} END AS value FROM hits),
 said AS (SELECT doc_id, board, field, rank, 0 AS i, constant AS value FROM c JOIN rules USING (board) WHERE kind = 'default' OR (kind = 'phrase' AND contains({_plain('text')}, ' ' || label || ' ')))
SELECT doc_id, board, field, arg_min(value, (rank, i, value)) AS value FROM (SELECT * FROM made WHERE value IS NOT NULL UNION ALL SELECT * FROM said) GROUP BY doc_id, board, field"""


@query("board_fields", _SQL)
def board_fields(spark, sf_dir):
    """Fields of each capture by its board's rules."""
    return B.board_fields(captures(spark, sf_dir), B.rules_table(spark), F.lit(AS_OF), "doc_id")
