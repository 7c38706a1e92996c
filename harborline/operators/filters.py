"""A reader's filters: read from the parameters of a list's address, checked against what is allowed, applied to rows."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.education import LEVEL_WORDS, matches_field, matches_level
from harborline.functions.posting_fields import languages_all, listing_mode
from harborline.functions.text import json_strings

# What parameters may say; anything else counts as absent.
MODES = ("In-person", "Hybrid", "Remote")
LANGUAGES = ("English", "French")
SALARIES = ("50000", "75000", "100000", "125000")
DEADLINES = ("0", "7", "14", "30", "-1")
LISTINGS = ("inventory", "ongoing_recruitment")
STAGES = ("student", "early-career", "experienced", "senior")


@dataclass(frozen=True)
class ListFilters:
    """A deadline excludes "newly added"; either of them excludes the order by newest."""

    search: str = ""
    location: str = ""
    salary: int | None = None
    modes: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    vehicle: bool = False
    deadline_days: int | None = None
    listing: str | None = None
    students: bool = False
    newly_added: bool = False
    newest_first: bool = False
    companies: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    field: str = ""
    stages: tuple[str, ...] = ()

    @staticmethod
    def of(address: str) -> ListFilters:
        """The filters of ``a=b&c=d`` parameters; of values that may occur once the first counts, lists hold each once."""
        given = parse_qs(address.removeprefix("?"), keep_blank_values=True)
        one = lambda key, allowed=None: next((v for v in given.get(key, [])[:1] if allowed is None or v in allowed), None)
        several = lambda key, allowed: tuple(dict.fromkeys(v for v in given.get(key, []) if v in allowed))
        deadline, salary = one("closing", DEADLINES), one("salary", SALARIES)
        added = one("added") == "7" and deadline is None
        return ListFilters(
            one("search") or "", one("location") or "", salary and int(salary), several("mode", MODES), several("language", LANGUAGES), one("vehicle") == "1", None if deadline is None else int(deadline), one("listing", LISTINGS), one("student") == "1",
            added, one("sort") == "newest" and deadline is None and not added, tuple(v for v in given.get("company", []) if v), several("degree", [level for level, _ in LEVEL_WORDS]), one("field") or "", several("stage", STAGES),
        )

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows that pass the filters on what a row says of itself. Filters that are off need no column; languages and
        education are JSON arrays. Days and places belong to the list's own view."""
        c, has = F.col, lambda name, text: F.lower(F.coalesce(F.col(name), F.lit(""))).contains(text.strip().lower())
        wanted = [
            has("description", self.search) if self.search.strip() else None, has("location", self.location) if self.location.strip() else None, c("salary_min") >= self.salary if self.salary else None,
            F.when(c("work_model") == "On-site", "In-person").otherwise(c("work_model")).isin(*self.modes) if self.modes else None, languages_all(json_strings(c("language_requirements")), list(self.languages)) if self.languages else None,
            c("vehicle_required") == 1 if self.vehicle else None, listing_mode(c("listing_type"), c("is_inventory"), self.listing) if self.listing else None, c("is_student") == 1 if self.students else None,
            c("company").isin(*self.companies) if self.companies else None, reduce(lambda a, b: a | b, (matches_level(c("education_requirements"), level) for level in self.levels)) if self.levels else None,
            matches_field(c("education_requirements"), self.field) if self.field.strip() else None, c("career_stage").isin(*self.stages) if self.stages else None,
        ]
        return reduce(lambda df, w: df.filter(w), [w for w in wanted if w is not None], rows)


def any_type(company: str, wanted: list[str], types: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose company, by the table ``types`` (name, type), has one of the types; all rows if none is wanted."""
    if not wanted:
        return rows
    return rows.join(types.filter(F.col("type").isin(*wanted)).select(F.col("name").alias(company)).distinct(), company, "left_semi")
