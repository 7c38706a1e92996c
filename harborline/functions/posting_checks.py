"""Checks and renderings of single values: places, titles, requirements, pay ranges, JSON lists, tags and dates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide what is kept.
LONGEST_REQUIREMENT = 220
PLACE_LENGTHS = (3, 48)
INTERNAL = ("internal to the public service", "public service only")
PLACEHOLDER_TITLE = "candidate profile"
NO_DATE = ("null", "n/a", "unknown", "not verified")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def plausible(value: Column) -> Column:
    """Short enough for one requirement, and at most one place where a sentence runs into the next."""
    return (F.length(value) <= LONGEST_REQUIREMENT) & (F.regexp_count(value, F.lit("[a-z][A-Z]")) < 2)


def usable_place(value: Column, prose: tuple[str, ...]) -> Column:
    """Every part between semicolons is, without a region code, of a place name's length and has no word of ``prose``."""
    least, most = PLACE_LENGTHS
    words = lambda city: F.split(F.lower(city), "[^a-z]+")

    def fine(part: Column) -> Column:
        city = F.trim(F.regexp_replace(part, ",\\s*[A-Z]{2}$", ""))
        return F.length(city).between(least, most) & ~F.arrays_overlap(words(city), F.array(*map(F.lit, prose)))

    clean = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))
    return (clean != "") & F.forall(F.split(clean, ";"), fine)


def eligible_listing(title: Column, row_text: Column) -> Column:
    """A title of three characters or more that is no placeholder, in a row open to the public."""
    text = F.lower(F.coalesce(row_text, F.lit("")))
    closed = F.exists(F.array(*map(F.lit, INTERNAL)), lambda p: F.contains(text, p))
    return F.coalesce(F.length(title) >= 3, F.lit(False)) & (F.lower(F.trim(title)) != PLACEHOLDER_TITLE) & ~closed


def has_open_parenthesis(value: Column) -> Column:
    """Whether a parenthesis is left open at the end: the text was cut. Closing ones without an opening don't count.

    With each ( as 1 and ) as -1, one stays open if the last sum lies above the least sum so far.
    """
    marks = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least"))

    def step(at: Column, mark: Column) -> Column:
        now = at["sum"] + F.when(mark == "(", 1).otherwise(-1)
        return F.struct(now.alias("sum"), F.least(at["least"], now).alias("least"))

    return F.aggregate(marks, start, step, lambda at: at["sum"] > at["least"])


def pay_range(low: Column, high: Column, period: Column) -> Column:
    """``low - high (period)`` with what is known of both; empty if neither is."""
    shown = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    some = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    return F.when(some, F.concat(shown(low), F.lit(" - "), shown(high), F.lit(" ("), shown(period), F.lit(")"))).otherwise("")


def json_kind(value: Column) -> Column:
    """list, other (valid JSON of another kind), malformed or empty."""
    parsed = F.try_parse_json(value)
    kind = F.when(F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), "list").otherwise("other")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "empty").when(parsed.isNull(), "malformed").otherwise(kind)


def known_tags(tags: Column, vocabulary: tuple[str, ...]) -> Column:
    """The tags of ``vocabulary``, each once, in their order."""
    return F.array_distinct(F.filter(tags, lambda t: t.isin(*vocabulary)))


def repaired_tags(tags: Column, vocabulary: tuple[str, ...], tag: str, missing: Column) -> Column:
    """``known_tags`` and, where ``missing`` holds and it isn't there, ``tag`` at the end."""
    known = known_tags(tags, vocabulary)
    return F.when(F.coalesce(missing, F.lit(False)) & ~F.array_contains(known, tag), F.array_append(known, F.lit(tag))).otherwise(known)


def shown_date(value: Column) -> Column:
    """``2026-08-04T10:00`` as ``Aug 4, 2026``; placeholders as nothing, everything else as it is."""
    day = F.trim(F.split_part(value, F.lit("T"), F.lit(1)))
    part = F.regexp_extract_all(day, F.lit("^([0-9]+)-([0-9]+)-([0-9]+)$"), F.lit(0))
    year, month, of_month = (F.split_part(day, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    dated = (F.size(part) == 1) & month.between(1, 12)
    text = F.concat(F.try_element_at(F.array(*map(F.lit, MONTHS)), F.when(dated, month)), F.lit(" "), of_month.cast("string"), F.lit(", "), year.cast("string"))
    return F.when(value.isNull() | F.lower(day).isin(*NO_DATE), "").when(dated, text).otherwise(value)
