"""Deadlines, start dates and pay: each document's text, and behind it what a posting says of them in turn."""
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions import deadlines as D
from harborline.plans.registry import query
from harborline.plans.sql import flat, has_phrase, plain, quote
from harborline.sources.tables import table

AS_OF = dt.date(2026, 1, 1)
SAID = (
    "Job Closing Date (April 2, 2026) and the closing date: May 1, 2026", "Closing Date (internal): March 5", "Application closes Jun 7, 2026", "Deadline to apply: Sept. 9, 2026", "Please submit your resume to HR by March 3, 2026.",
    "This page expires on 2026-10-01", "Posting end date runs from Jan 5, 2026 to Jan 25, 2026", "The close date is at noon on April 8, 2026", "Closing date of 2026/4/9", "Our deadline is on Friday, March 6, 2026",
    "Applications must be received by 3/9/2026", "The competition will close at 4 pm on March 10, 2026", "Apply online at our site by March 11, 2026", "Time left to apply 3 days End Date: March 12, 2026", "Posting Period: Feb 1, 2026 to Feb 20, 2026",
    "Closing date: February 30, 2026", "Closing date: TBD", "The licence expires 5 years after issue. Apply by 3 means: mail or phone", "There is no date set for the picnic", "No closing deadline; open until the position has been filled", "No application deadline", "Deadline: 99-99-2026",
    "Start date is July 1, 2027 at $25.50 - $30 per hour", "Expected start date will be January, 2027. Salary: $80,000", "Prior to start date: March 1, 2026 you provide a cover letter. Donations of $5 are welcome", "Start Date: End Date: June 1, 2026", "Anticipated start date: Fall Semester 2026", "Start date: immediate. Wages are $21/hr",
)


def postings(spark, sf_dir: str) -> DataFrame:
    """(doc_id, said): in every other turn only what is planted stands there, so that distances to the text vary."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("said"))


_SAID = f"c AS (SELECT doc_id, {flat(f'coalesce(text, {quote(chr(32))}) || chr(10) || list_extract([{chr(44).join(map(quote, SAID))}], CAST(doc_id % {len(SAID)} + 1 AS INTEGER))')} AS t FROM documents)"


def _found(name: str, pattern: str) -> str:
    """CTE ``name`` (doc_id, k, s, e, m): the matches of ``pattern`` with their places, from 0."""
    p = quote(pattern)
    return f"""{name}_l AS (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS gs FROM c),
 {name}_r AS (SELECT doc_id, k, ms[k] AS m, length(gs[k]) AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM {name}_l)),
 {name} AS (SELECT doc_id, k, m, e - length(m) AS s, e FROM (SELECT *, CAST(sum(g + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e FROM {name}_r))"""


def _date(x: str, years: int) -> str:
    """The date of a match in one of the forms that the texts have; without a year in that of AS_OF."""
    bare = rf"regexp_replace(regexp_replace({x}, '^(?i)(mon|tues|wednes|thurs|fri|satur|sun)day,? ', ''), '\. ?', ' ', 'g')"
    bare = f"regexp_replace({bare}, '^(?i)sept ', 'Sep ')"
    forms = ("%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%m/%d/%Y")
    parsed = "coalesce(" + ", ".join(f"try_strptime({v}, '{f}')" for v in (bare, f"{bare} || ', {AS_OF.year}'") for f in forms) + ")"
    return f"CASE WHEN year({parsed}) BETWEEN 2000 AND {AS_OF.year + years} THEN CAST({parsed} AS DATE) END"


_in = lambda values: "(" + ", ".join(map(quote, values)) + ")"
_FAMILY = "CASE " + " ".join(f"WHEN {n} = f THEN label IN {_in(D._accepted(labels))} AND regexp_matches(gap, {quote('(?i)' + gap)})" + ("" if dot is None else f" AND dot = {str(dot).upper()}") for n, (labels, gap, dot) in enumerate(D.FAMILIES)) + " END"
_CLOSING = f"""WITH {_SAID}, {_found('d', D.DATE)}, {_found('l', D.LABEL)},
 pairs AS (SELECT l.doc_id, l.k AS lk, d.k AS dk, lower(l.m) AS label, substring(t, l.e + 1, d.s - l.e) AS gap, {_date('d.m', 5)} AS date, regexp_matches(d.m, '[A-Za-z]\\.') AS dot FROM l JOIN d USING (doc_id) JOIN c USING (doc_id) WHERE d.s >= l.e AND d.s - l.e <= {D.REACH}),
 best AS (SELECT doc_id, arg_min(date, (f, lk, dk)) AS date FROM pairs, range({len(D.FAMILIES)}) AS t(f) WHERE date IS NOT NULL AND {_FAMILY} GROUP BY doc_id),
 bad AS (SELECT DISTINCT doc_id FROM l JOIN c USING (doc_id) WHERE regexp_matches(substring(t, l.e + 1, 80), {quote(D.INVALID)}))
SELECT doc_id, date, CASE WHEN date IS NOT NULL THEN 'known' WHEN t = '' THEN 'not_checked' WHEN {has_phrase(plain('t'), D.OPEN)} THEN 'open_until_filled' WHEN {has_phrase(plain('t'), D.NO_DATE)} THEN 'not_listed' WHEN bad.doc_id IS NOT NULL THEN 'invalid' ELSE 'not_checked' END AS status
FROM c LEFT JOIN best USING (doc_id) LEFT JOIN bad USING (doc_id)"""


@query("closing_dates", _CLOSING)
def closing_dates(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", D.closing(F.col("said"), F.lit(AS_OF)).alias("c")).select("doc_id", "c.date", "c.status")


_after = "ltrim(regexp_replace(substring(t, e + 1, 100), '(?i)^ ?(will be|is|of|:|-) ?', ''))"
_value = f"regexp_extract({_after}, {quote(D.START_VALUE)})"
_titled = lambda p: f"upper(regexp_extract(v, {quote(p)}, 1)[1]) || lower(regexp_extract(v, {quote(p)}, 1)[2:]) || ' ' || regexp_extract(v, {quote(p)}, 2)"
_season, _month = rf"(?i)^({D.SEASON})(?: semester)? (\d{{4}})$", rf"(?i)^({D.MONTH}),? (\d{{4}})$"
_START = f"""WITH {_SAID}, {_found('l', D.START_LABEL)},
 seen AS (SELECT doc_id, s, substring(t, e + 1, 4) = ' is ' AS prose, lower(m) = 'start date' AND {has_phrase(plain('substring(t, greatest(s - 40, 0) + 1, e + 20 - greatest(s - 40, 0))'), D.START_NOISE)} AS noisy, m,
   CASE WHEN NOT ({' OR '.join(f'starts_with(lower({_after}), {quote(p)})' for p in D.NEXT_FIELD)}) THEN {_value} END AS v FROM l JOIN c USING (doc_id)),
 made AS (SELECT doc_id, s, CASE WHEN prose AND ends_with(lower(m), 'start date') THEN 0 ELSE 1 END AS rank, CASE WHEN NOT noisy OR prose THEN CASE WHEN lower(v) IN ('immediate', 'asap') THEN 'Immediate' WHEN regexp_matches(v, {quote(_season)}) THEN {_titled(_season)} WHEN regexp_matches(v, {quote(_month)}) THEN {_titled(_month)} ELSE CAST({_date('v', 3)} AS VARCHAR) END END AS value FROM seen)
SELECT doc_id, arg_min(value, (rank, s)) AS start_date FROM made WHERE value IS NOT NULL GROUP BY doc_id"""


@query("start_dates", _START)
def start_dates(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", D.start_date(F.col("said"), F.lit(AS_OF)).alias("start_date")).filter("start_date IS NOT NULL")


_PAY = f"""WITH {_SAID}, {_found('l', D.MONEY)},
 near AS (SELECT doc_id, k, trim(m) AS m, lower(substring(t, greatest(s - {D.AROUND}, 0) + 1, e + {D.AROUND} - greatest(s - {D.AROUND}, 0))) AS around FROM l JOIN c USING (doc_id))
SELECT doc_id, arg_min(m, k) AS pay FROM near WHERE {' OR '.join(f"contains(around, '{p}')" for p in D.PAY_WORDS)} GROUP BY doc_id"""


@query("pending_pay", _PAY)
def pending_pay(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", D.pay_text(F.col("said")).alias("pay")).filter("pay IS NOT NULL")
