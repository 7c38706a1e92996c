"""Fields of captures by rules of their boards: a table of rules, joined to each capture's labelled values.

A capture gives one row for each label and value, with the label's last words as join keys; so a rule for "Salary
Range" also meets "Hiring Salary Range". Rules are joined by board and label, phrases by board, and the best rule
with a value decides each field. Nothing is evaluated rule by rule, so a rule table may grow without another pass.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions import dates, pay, terms, titles
from harborline.functions.sections import words_key
from harborline.functions.text import collapse, has_phrase, plain_words

SCHEMA = "board string, field string, kind string, label string, format string, value string, rank int"
#: Rules up to which the table is sent to all executors; more are joined by a shuffle.
BROADCAST = 20_000
#: Words of a label, at most, that a rule may name, and characters of a label.
LABEL_WORDS, LABEL_LENGTH = 5, 60
DATE = r"(?i)\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|[a-z]{3,9}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2}[- ][a-z]{3,9}[- ]\d{2,4}"


def _labels(board: str, field: str, form: str, *labels: str) -> list[tuple]:
    """Rules for labels, the first before the others."""
    return [(board, field, "label", label, form, None, rank) for rank, label in enumerate(labels)]


def _pay(board: str, *labels: str) -> list[tuple]:
    return [rule for field, form in (("salary", "text"), ("salary_low", "low"), ("salary_high", "high"), ("salary_period", "period")) for rule in _labels(board, field, form, *labels)]


def _union(board: str, *labels: str) -> list[tuple]:
    return _labels(board, "union_name", "union", *labels) + _labels(board, "is_unionized", "member", *labels)


def _phrases(board: str, field: str, *pairs: tuple[str, str]) -> list[tuple]:
    """Constants for phrases anywhere in the text, after all labels; an empty phrase is the default."""
    return [(board, field, "phrase" if phrase else "default", phrase, "text", value, 50 + rank) for rank, (phrase, value) in enumerate(pairs)]


# The labels of each board, in the order in which they decide.
RULES: tuple[tuple, ...] = (
    *_union("hamilton", "Union"), *_labels("hamilton", "closing_date", "last_date", "Close date"), *_labels("hamilton", "duration", "text", "Duration"),
    *_labels("hamilton", "employment_type", "contract", "Duration"), *_phrases("hamilton", "employment_type", ("", "Permanent")),
    *_phrases("hamilton", "work_model", ("hybrid", "Hybrid"), ("remote", "Remote"), ("", "On-site")),
    *_labels("toronto", "department", "department", "Division & Section"), *_labels("toronto", "location", "text", "Work Location"), *_labels("toronto", "employment_type", "employment", "Job Type & Duration"),
    *_labels("toronto", "duration", "length", "Job Type & Duration"), *_pay("toronto", "Salary Range"), *_labels("toronto", "hours", "text", "Shift Information"), *_union("toronto", "Affiliation"), *_labels("toronto", "closing_date", "last_date", "Posting Period"),
    *_labels("workday", "department", "department", "Department"), *_pay("workday", "Salary Range", "Hiring Range"), *_labels("workday", "hours", "text", "Scheduled Weekly Hours"), *_labels("workday", "duration", "text", "Term", "Length of Contract"),
    *_labels("workday", "employment_type", "contract", "Term", "Length of Contract"), *_labels("workday", "closing_date", "date", "Posting Closing Date", "Closing Date"),
    *_labels("icims", "employment_type", "employment", "Status"), *_labels("icims", "location", "text", "Location"), *_pay("icims", "Annual Salary", "Hourly wage", "Salary", "Wage"),
    *_phrases("icims", "union_name", ("opseu", "OPSEU"), ("ona", "ONA"), ("non union", "")), *_phrases("icims", "is_unionized", ("opseu", "true"), ("ona", "true"), ("non union", "false")),
    *_pay("adp", "Salary Range"), *_labels("adp", "department", "department", "Department and Commission", "Department"), *_labels("adp", "employment_type", "employment", "Vacancy Type", "Employment Type"), *_labels("adp", "closing_date", "date", "Application Deadline"),
    *_phrases("adp", "employment_type", ("part time", "Part-time"), ("full time", "Full-time")),
    *_pay("dayforce", "Rate of Pay", "Salary Range"), *_labels("dayforce", "employment_type", "employment", "Employment type"), *_labels("dayforce", "duration", "text", "Duration of employment", "Duration"), *_labels("dayforce", "hours", "text", "Hours of work"),
    *_labels("dayforce", "location", "text", "Work location", "Location"), *_labels("dayforce", "department", "department", "Business unit", "Division"),
    *_pay("njoyn", "Salary"), *_labels("njoyn", "employment_type", "employment", "Job Type", "JD#"), *_labels("njoyn", "hours", "text", "Hours of work"), *_union("njoyn", "Union"), *_labels("njoyn", "duration", "length", "Vacancy Type"),
    *_labels("taleo", "department", "department", "Department"), *_pay("taleo", "Pay Range"), *_labels("taleo", "employment_type", "employment", "Job Details"), *_labels("taleo", "closing_date", "date", "Closing Date"),
    *_pay("successfactors", "Salary"), *_labels("successfactors", "department", "department", "Department / Unit", "Department"), *_labels("successfactors", "location", "text", "Site", "City"), *_union("successfactors", "Union"),
    *_labels("successfactors", "closing_date", "date", "Posting End Date"), *_labels("successfactors", "work_model", "model", "Work Arrangement"),
    *_labels("technomedia", "department", "department", "Department/Faculty (BU)"), *_union("technomedia", "Affiliation"), *_labels("technomedia", "employment_type", "employment", "Job Details"), *_pay("technomedia", "Compensation"),
    *_labels("technomedia", "hours", "text", "Total Weekly Hours of Work"), *_labels("technomedia", "location", "text", "Job Location"),
    *_pay("jobs2web", "Salary", "Rate of Pay"), *_labels("jobs2web", "closing_date", "date", "Job Closing Date", "Closing Date"),
    *_labels("canada", "closing_date", "date", "Closing date"), *_pay("canada", "Salary"), *_labels("canada", "location", "text", "Location"),
    *_labels("peoplesoft", "department", "department", "Department"), *_pay("peoplesoft", "Salary Range", "Salary"), *_labels("peoplesoft", "closing_date", "date", "Closing Date"), *_union("peoplesoft", "Affiliation", "Union", "Bargaining Unit"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), SCHEMA)


def _key(label: Column) -> Column:
    """A label as its words; what stands in parentheses counts only where there is nothing else."""
    return F.coalesce(F.nullif(words_key(F.regexp_replace(label, r"\([^)]*\)", " ")), F.lit("")), words_key(label))


def labelled_values(captures: DataFrame, key: str, text: str) -> DataFrame:
    """(key, board, line, value, label) for each line with a label: what follows its colon, or the next line where nothing
    does or there is no colon. ``label`` are the last one to five words of it, each in a row. Blank lines don't count."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), collapse), lambda x: x != "")
    rows = captures.select(key, "board", lines.alias("lines")).select(key, "board", "lines", F.posexplode("lines").alias("line", "raw"))
    shape = rf"^([^:]{{1,{LABEL_LENGTH}}}):(.*)$"
    named, rest = F.regexp_extract("raw", shape, 1), F.trim(F.regexp_extract("raw", shape, 2))
    label = F.when(named != "", named).when(F.length("raw") <= LABEL_LENGTH, F.col("raw"))
    value = F.coalesce(F.nullif(rest, F.lit("")), F.get("lines", F.col("line") + 1))
    rows = rows.select(key, "board", "line", value.alias("value"), F.split(_key(label), " ").alias("words")).filter("value IS NOT NULL AND words[0] <> ''")
    ends = F.transform(F.sequence(F.greatest(F.size("words") - LABEL_WORDS, F.lit(0)), F.size("words") - 1), lambda s: F.array_join(F.slice("words", s + 1, F.size("words") - s), " "))
    return rows.select(key, "board", "line", "value", F.explode(ends).alias("label"))


def _formatted(form: Column, value: Column, as_of: Column) -> Column:
    """``value`` as the rule's format says; null where it holds nothing of the kind."""
    found = F.filter(F.transform(F.regexp_extract_all(value, F.lit(DATE), F.lit(0)), lambda d: dates.normalize_date(d, as_of, 5)), lambda d: d.isNotNull())
    amounts, member = pay.pay_range(value), terms.union_fields(value, F.lit(True))
    money = lambda x: F.format_string("%.2f", x)
    none = plain_words(value).isin(" n a ", " none ")
    of = {
        "text": F.when(~none, value), "department": F.nullif(titles.department(value), F.lit("")), "employment": terms.employment_type(value), "contract": F.when(~none, "Contract"), "model": terms.work_model(value),
        "length": F.when(has_phrase(plain_words(value), ("permanent",)), "Permanent").otherwise(F.coalesce(F.nullif(F.regexp_extract(value, r"(?i)\d+ (?:month|year)s?|temporary", 0), F.lit("")), F.lit("Contract"))),
        "low": F.when(amounts["low"].isNotNull(), money(amounts["low"])), "high": F.when(amounts["high"].isNotNull(), money(amounts["high"])), "period": terms.salary_period(value),
        "union": member["union_name"], "member": member["is_unionized"].cast("string"), "date": F.get(found, F.lit(0)).cast("string"), "last_date": F.get(found, F.size(found) - 1).cast("string"),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, made in of.items():
        out = out.when(form == name, made)
    return out


def board_fields(captures: DataFrame, rules: DataFrame, as_of: Column, key: str = "id", text: str = "text") -> DataFrame:
    """(key, board, field, value) of ``captures`` (key, board, text): for each field the value of its board's best rule.

    A rule with a smaller rank goes first, then an earlier line. Labels without a usable value pass to the next
    rule, phrases and defaults come last. Null texts have defaults only; captures of a board without rules,
    null boards included, have no rows.
    """
    small = rules.limit(BROADCAST + 1).count() <= BROADCAST
    sent = (lambda r: F.broadcast(r)) if small else (lambda r: r)
    named = rules.filter("kind = 'label'").select("board", "field", _key(F.col("label")).alias("label"), "format", "rank")
    by_label = labelled_values(captures, key, text).join(sent(named), ["board", "label"])
    by_label = by_label.select(key, "board", "field", "rank", "line", _formatted(F.col("format"), F.col("value"), as_of).alias("value")).filter("value IS NOT NULL")
    said = captures.select(key, "board", plain_words(F.col(text)).alias("words"))
    others = rules.filter("kind <> 'label'").select("board", "field", F.coalesce("label", F.lit("")).alias("phrase"), F.col("value").alias("constant"), "rank")
    hit = (F.col("phrase") == "") | F.contains("words", F.concat(F.lit(" "), "phrase", F.lit(" ")))
    constant = said.join(sent(others), "board").filter(hit).select(key, "board", "field", "rank", F.lit(0).alias("line"), F.col("constant").alias("value"))
    best = by_label.unionByName(constant).groupBy(key, "board", "field").agg(F.min_by("value", F.struct("rank", "line", "value")).alias("value"))
    return best.select(key, "board", "field", "value")
