"""Derived columns and filters of a posting, from what was parsed, what is pending and the captured text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.text import placeholder_to_null

# Fixed phrases: they decide what a listing shows.
EMPLOYMENT = {"Full-time": ("full-time", "full time"), "Part-time": ("part-time", "part time"), "Contract": ("temporary", "contract")}
SIXTEEN_WEEKS = ("16-week", "16 week")
TWO_YEARS = ("up to two years",)
FIXED_TERM = ("fixed-term", "fixed term")
INVENTORY = ("eligibility list", "candidate inventory", "inventory for future", "not applying for a specific job")
ONGOING = ("hiring pool", "candidate pool", "talent pool", "ongoing recruitment")
UNTIL_FILLED = (
    "open till filled", "open until filled", "posted until filled", "remains open until filled", "remains active until filled", "will be posted until filled",
    "open until suitable candidate found", "open until a suitable candidate found", "open until vacancies are filled", "remain posted until filled", "remain active until filled",
)
UNTIL_FILLED_BESIDE = ("closing date", "application deadline", "posting close", "competition close")
ACCEPTING = ("accepting applications until filled",)
NO_DEADLINE = ("no deadline", "without a deadline", "deadline not listed")
INVALID_DEADLINE = ("closing date: tbd", "closing date: n/a", "closing date: none")
EDUCATION = {"high_school": "high school", "diploma": "diploma", "bachelors": "bachelor", "masters": "master", "doctorate": "doctor", "student": "enrolled"}
CAREER_STAGES = ("student", "early-career", "experienced", "senior")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def source_text(title: Column, raw_text: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(raw_text, F.lit(""))))


def first_stated(*values: Column) -> Column:
    """The first value that is neither empty nor a placeholder."""
    return F.coalesce(*map(placeholder_to_null, values))


def public_title(*titles: Column) -> Column:
    """The first title that is neither empty nor a page's skip link."""
    usable = lambda t: F.when(~F.lower(F.trim(t)).startswith("skip to"), F.nullif(F.trim(t), F.lit("")))
    return F.coalesce(*map(usable, titles))


def employment_type(stored: Column, text: Column) -> Column:
    found = [F.when(any_of(text, phrases), F.lit(kind)) for kind, phrases in EMPLOYMENT.items()]
    return F.coalesce(stored, *found)


def duration(stored: Column, pending: Column, text: Column) -> Column:
    return F.coalesce(stored, F.when(any_of(text, SIXTEEN_WEEKS), "16 weeks"), F.when(any_of(text, TWO_YEARS), "Training up to 2 years"), pending, F.when(any_of(text, FIXED_TERM), "Term"))


def listing_type(stored: Column, parsed: Column, text: Column) -> Column:
    return F.coalesce(stored, F.when(parsed, "regular").when(any_of(text, INVENTORY), "inventory").when(any_of(text, ONGOING), "ongoing_recruitment").otherwise("regular"))


def is_inventory(flag: Column, kind: Column) -> Column:
    return ((F.coalesce(flag, F.lit(0)) == 1) | (kind == "inventory")).cast("int")


def open_until_filled(text: Column) -> Column:
    return any_of(text, UNTIL_FILLED) | (text.contains("until filled") & any_of(text, UNTIL_FILLED_BESIDE))


def closing_status(closing: Column, pending_status: Column, parsed: Column, text: Column) -> Column:
    """known, blocked, what is pending for unparsed rows, open_until_filled, not_listed, invalid or not_checked."""
    from_text = F.when(open_until_filled(text) | any_of(text, ACCEPTING), "open_until_filled").when(any_of(text, NO_DEADLINE), "not_listed").when(any_of(text, INVALID_DEADLINE), "invalid").otherwise("not_checked")
    return F.when(closing.isNotNull(), "known").when(pending_status == "blocked", "blocked").when(~parsed, F.coalesce(pending_status, F.lit("not_checked"))).otherwise(from_text)


def freshness_date(posted: Column, first_seen: Column, today: Column) -> Column:
    """The posted date where it is a date that isn't in the future, else the day first seen."""
    day = F.try_to_date(F.substring(posted, 1, 10), "yyyy-MM-dd")
    return F.when(day <= today, day).otherwise(F.to_date(first_seen))


def education_levels(text: Column, levels: list[str]) -> Column:
    """Any of the known ``levels``; others don't count, and without one every row passes."""
    phrases = tuple(EDUCATION[x] for x in levels if x in EDUCATION)
    return any_of(F.lower(F.coalesce(text, F.lit(""))), phrases) if phrases else F.lit(True)


def career_stages(stage: Column, stages: list[str]) -> Column:
    known = [x for x in stages if x in CAREER_STAGES]
    return F.coalesce(stage.isin(known), F.lit(False)) if known else F.lit(True)


def languages_all(required: Column, languages: list[str]) -> Column:
    """Every language is named in the array ``required``, where a bilingual entry stands for all."""
    return F.forall(F.array(*map(F.lit, languages)), lambda want: F.exists(required, lambda x: F.contains(F.lower(x), F.lower(want)) | F.contains(F.lower(x), F.lit("bilingual"))))


def listing_mode(kind: Column, inventory: Column, mode: str | None) -> Column:
    """Inventories only on demand; ``mode``: None, inventory or ongoing_recruitment."""
    return {"inventory": inventory == 1, "ongoing_recruitment": kind == "ongoing_recruitment"}.get(mode, inventory == 0)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays of strings hold the same values, whatever their order, case and repetition."""
    flat = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda v: F.lower(F.trim(v)))))
    return flat(a) == flat(b)


def joined(values: Column, mapper=lambda x: x) -> Column:
    """The mapped values that are neither null nor empty, by comma; null without one."""
    return F.nullif(F.array_join(F.filter(F.transform(values, mapper), lambda x: F.coalesce(x, F.lit("")) != ""), ", "), F.lit(""))
