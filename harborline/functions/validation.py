"""Whole captured rows: a JSON object of loose values becomes typed columns and a list of issues in one pass.

A row is accepted if it is a JSON object with a title. Each value that is given is either kept or named by an
issue; for lists this holds entry by entry, so the counts of both add up (``field_counts``). Values that
belong to another field go: among skills those on languages and driving, and licences where the licences
have a field of their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import licences as L
from harborline.functions import requirements as R
from harborline.functions import sections, terms, text, titles
from harborline.functions.dates import normalize_date
from harborline.functions.durations import duration
from harborline.functions.posting_checks import plausible
from harborline.functions.text import has_phrase, let

# The fields of a captured row by their kind.
TEXTS = ("location", "workplace_address", "hours", "availability", "academic_course", "academic_supervisor", "union_name")
NUMBERS = ("salary_min", "salary_max")
FLAGS = ("is_student", "is_inventory", "is_unionized", "vehicle_required", "security_check_required")
CHOICES = ("salary_period", "work_model", "employment_type")
LISTS = ("benefits", "required_skills", "experience_requirements", "license_requirements", "language_requirements", "software_requirements", "responsibility_tags", "qualification_tags")
SCALARS = ("job_title", "department", "closing_date", "duration", *TEXTS, *NUMBERS, *CHOICES, *FLAGS)
PROFICIENCY = ("fluency", "fluent", "fluently", "proficiency", "proficient", "bilingual", "bilingualism", "spoken", "written")
ISSUE = "struct<field:string,kind:string,entries:int>"


def _given(v: Column, field: str) -> Column:
    """A scalar as text; null for placeholders, objects and arrays."""
    scalar = lambda x: ~F.schema_of_variant(x).rlike("^(?:ARRAY|OBJECT)")
    return let(F.try_variant_get(v, f"$.{field}", "variant"), lambda x: F.when(scalar(x), let(x.cast("string"), text.placeholder_to_null)))


def _entries(v: Column, field: str) -> Column:
    """struct<values, given>: the texts of a list, or the parts of one text, and how many entries there were."""
    value = F.try_variant_get(v, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    none = F.expr("CAST(array() AS array<string>)")

    def of_array(parts: Column) -> Column:
        texts = F.transform(F.filter(parts, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(x.cast("string")))
        return F.struct(F.filter(texts, lambda x: x != "").alias("values"), F.size(parts).alias("given"))

    of_text = lambda parts: F.struct(parts.alias("values"), F.size(parts).alias("given"))
    lost = F.when(kind.isNull() | (kind == "VOID"), 0).otherwise(1)
    return (
        F.when(F.startswith(kind, F.lit("ARRAY")), let(F.when(F.startswith(kind, F.lit("ARRAY")), value.cast("array<variant>")), of_array))
        .when(kind == "STRING", let(text.string_list(F.when(kind == "STRING", value.cast("string"))), of_text))
        .otherwise(F.struct(none.alias("values"), lost.alias("given")))
    )


def is_elsewhere(skill: Column, licences: Column) -> Column:
    """Whether a skill is a matter of languages, of driving, or of licences where ``licences`` names some."""

    def judged(words: Column) -> Column:
        language = has_phrase(words, [p for _, phrases in R.LANGUAGES for p in phrases]) & has_phrase(words, PROFICIENCY)
        return language | has_phrase(words, R.BILINGUAL) | has_phrase(words, L.DRIVER) | ((F.size(licences) > 0) & has_phrase(words, L.TERMS))

    return let(R.line_words(skill), judged)


def _list_issues(field: str, kept: Column) -> Column:
    """What went from a list: entries that aren't text, repeated ones, and those that the field doesn't take."""
    raw = F.col(f"{field}_given")
    once = F.size(F.array_distinct(raw["values"]))
    unread, repeated, refused = raw["given"] - F.size(raw["values"]), F.size(raw["values"]) - once, once - F.size(kept)
    kinds = (("unreadable", unread), ("repeated", repeated), ("refused", refused))
    return F.array(*(F.when(n > 0, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), n.cast("int").alias("entries"))) for kind, n in kinds))


def validated(df: DataFrame, key: str, captured: str, tags: tuple[str, ...], as_of: Column) -> DataFrame:
    """(key, accepted, row, issues) of each row's JSON text ``captured``.

    ``row`` is a struct of the typed fields, null where the row isn't accepted; ``issues`` an array of (field,
    kind, entries): ``unreadable`` (given, not kept), ``assumed`` (a choice that isn't known takes the field's
    usual value), ``repeated`` and ``refused`` (list entries), ``order`` (a minimum above the maximum; both
    stay), ``missing`` (the title) and ``row`` / ``unreadable`` (no JSON object). Null and empty text is no
    object. Other columns are ignored; equal keys are judged apart.
    """
    rows = df.select(F.col(key), text.once(F.try_parse_json(F.col(captured))).alias("_v"))
    rows = rows.select(key, text.once(F.when(F.startswith(F.schema_of_variant(F.col("_v")), F.lit("OBJECT")), F.col("_v"))).alias("_v"))
    rows = rows.select(key, F.col("_v").isNotNull().alias("is_object"), *(_given(F.col("_v"), f).alias(f"{f}_given") for f in SCALARS), *(_entries(F.col("_v"), f).alias(f"{f}_given") for f in LISTS))

    given = lambda f: F.col(f"{f}_given")
    values = lambda f: F.array_distinct(given(f)["values"])
    known = lambda f, c: F.when(given(f).isNotNull(), c)
    typed = {
        "job_title": F.nullif(titles.job_title(given("job_title")), F.lit("")),
        "department": F.nullif(titles.department(given("department")), F.lit("")),
        "closing_date": normalize_date(given("closing_date"), as_of),
        "duration": F.nullif(duration(given("duration")), F.lit("")),
        **{f: text.blank_to_null(given(f)) for f in TEXTS},
        **{f: text.number(given(f)) for f in NUMBERS},
        "salary_period": known("salary_period", terms.salary_period(given("salary_period"))),
        "work_model": known("work_model", terms.work_model(given("work_model"), given("job_title"))),
        "employment_type": known("employment_type", terms.employment_type(given("employment_type"))),
        **{f: text.flag(given(f)) for f in FLAGS},
        "benefits": values("benefits"),
        "required_skills": F.filter(values("required_skills"), lambda s: ~is_elsewhere(s, values("license_requirements"))),
        "experience_requirements": F.filter(values("experience_requirements"), plausible),
        "license_requirements": F.filter(values("license_requirements"), plausible),
        "language_requirements": sections.languages(values("language_requirements")),
        "software_requirements": values("software_requirements"),
        **{f: F.filter(values(f), lambda t: t.isin(*tags)) for f in ("responsibility_tags", "qualification_tags")},
    }
    union = terms.union_fields(given("union_name"), text.flag(given("is_unionized")) == 1)
    rows = rows.select("*", *(c.alias(f) for f, c in typed.items() if f not in ("union_name", "is_unionized")), union.alias("_union"))
    rows = rows.withColumn("union_name", F.nullif(F.col("_union.union_name"), F.lit(""))).withColumn("is_unionized", F.when(given("union_name").isNotNull() | given("is_unionized").isNotNull(), F.col("_union.is_unionized").cast("int")))
    strict = {"salary_period": terms.salary_period(given("salary_period"), True), "work_model": terms.work_model(given("work_model"), given("job_title"), True), "employment_type": terms.employment_type(given("employment_type"), True)}

    issue = lambda f, kind: F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), F.lit(1).alias("entries"))
    lost = [F.when(given(f).isNotNull() & F.col(f).isNull(), issue(f, "unreadable")) for f in SCALARS if f != "job_title"]
    lost += [F.when(given(f).isNotNull() & strict[f].isNull(), issue(f, "assumed")) for f in CHOICES]
    lost += [F.when(F.col("salary_min") > F.col("salary_max"), issue("salary_min", "order"))]
    of_lists = [_list_issues(f, F.col(f)) for f in LISTS]
    found = F.filter(F.flatten(F.array(F.array(*lost), *of_lists)), lambda x: x.isNotNull())
    titled = text.blank_to_null(given("job_title")).isNotNull()  # a title is never cut down to nothing
    issues = F.when(~F.col("is_object"), F.array(issue("row", "unreadable"))).when(~titled, F.array(issue("job_title", "missing"))).otherwise(found)
    accepted = F.col("is_object") & titled
    counts = [F.when(accepted, given(f).isNotNull().cast("int")) for f in SCALARS] + [F.when(accepted, given(f)["given"]) for f in LISTS]
    return rows.select(key, accepted.alias("accepted"), F.when(accepted, F.struct(*SCALARS, *LISTS)).alias("row"), issues.cast(f"array<{ISSUE}>").alias("issues"), F.array(*counts).alias("given"))


def accepted_rows(checked: DataFrame, key: str) -> DataFrame:
    """(key, typed fields) of the accepted rows of ``validated``."""
    return checked.filter("accepted").select(key, "row.*")


def issue_rows(checked: DataFrame, key: str) -> DataFrame:
    """(key, accepted, field, kind, entries): one row for each issue."""
    each = checked.select(key, "accepted", F.explode_outer("issues").alias("i"))  # a plain explode has a filter on the array pushed down, which computes all fields twice
    return each.filter("i IS NOT NULL").select(key, "accepted", "i.*")


def field_counts(checked: DataFrame) -> DataFrame:
    """(field, given, kept) over the accepted rows: values, or entries of lists. ``given`` less ``kept`` is what the
    issues ``unreadable``, ``repeated`` and ``refused`` count, but for a union's name and flag, which decide together.
    One row a field, also for an empty table."""
    fields = (*SCALARS, *LISTS)
    kept = lambda f: F.size(f"row.{f}") if f in LISTS else F.col(f"row.{f}").isNotNull().cast("int")
    sums = [F.struct(F.lit(f).alias("field"), F.coalesce(F.sum(F.col("given")[i]), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(F.col("accepted"), kept(f))), F.lit(0)).alias("kept")) for i, f in enumerate(fields)]
    return checked.agg(F.array(*sums).alias("sums")).select(F.explode("sums").alias("s")).select("s.*")


def reconciled(stored: Column, extracted: Column) -> Column:
    """What the description says, else what is stored; each entry once."""
    return F.array_distinct(F.when(F.size(extracted) > 0, extracted).otherwise(stored))


def merged_benefits(stored: Column, named: Column) -> Column:
    """Stored benefits and those that the description names. Of stored ones that hold a named one the longest
    stays (the first of equal length); a named one that none holds comes at the end."""

    def put(have: Column, name: Column) -> Column:
        holds = lambda x: F.contains(R.line_words(x), R.line_words(name)) | F.contains(sections.words_key(x), sections.words_key(name))

        def joined(hits: Column) -> Column:
            best = F.filter(hits, lambda x: F.length(x) == F.array_max(F.transform(hits, lambda y: F.length(y))))[0]
            return F.when(F.size(hits) == 0, F.array_append(have, name)).otherwise(F.filter(have, lambda x: ~F.array_contains(hits, x) | (x == best)))

        return let(F.filter(have, holds), joined)

    return F.aggregate(named, F.array_distinct(stored), put)


def skills_left(skills: Column, licences: Column, benefits: Column, required: Column) -> Column:
    """Distinct skills without those of other fields, and without benefits that no required line names."""
    keys = lambda xs: F.transform(xs, lambda x: sections.words_key(x))

    def stays(s: Column) -> Column:
        key = sections.words_key(s)
        only = F.array_contains(keys(benefits), key) & ~F.exists(keys(required), lambda x: F.contains(x, key))
        return ~is_elsewhere(s, licences) & ~only

    return F.filter(F.array_distinct(skills), stays)
