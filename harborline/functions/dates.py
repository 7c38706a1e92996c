"""Dates from free text as column expressions; the current date is always a parameter."""
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A real calendar date or null; two-digit years below 80 lie in this century."""
    year = y.try_cast("int")
    year = F.when(F.length(y) == 2, F.when(year < 80, year + 2000).otherwise(year + 1900)).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd")


def _month(c: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(c, 1, 3)))
    return F.when(at > 0, (at + 3) / 4).cast("int").cast("string")


def normalize_date(c: Column, as_of: Column, years_ahead: int = 2) -> Column:
    """The date that a text begins with: ISO, Y/M/D, Month D Y, D Month Y, D-Mon-YY, M/D/Y (D/M/Y where the
    first number is no month). Null unless it is a real date from 2000 to ``years_ahead`` after ``as_of``."""
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+", "")
    month = rf"({MONTHS})[a-z]*\.?"

    def found(pattern: str, order: str, month_at: int | None = None) -> Column:
        part = {k: F.regexp_extract(t, pattern, i + 1) for i, k in enumerate(order)}
        if month_at is not None:
            part["m"] = _month(part["m"])
        return F.when(t.rlike(pattern), _ymd(part["y"], part["m"], part["d"]))

    slash = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})\b"
    first = F.regexp_extract(t, slash, 1).try_cast("int")
    numeric = F.when(t.rlike(slash), F.when(first > 12, found(slash, "dmy")).otherwise(found(slash, "mdy")))
    date = F.coalesce(
        found(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "ymd"),
        found(rf"(?i)^{month}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", "mdy", 0),
        found(rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{month},?[\s-]+(\d{{4}}|\d{{2}})\b", "dmy", 1),
        numeric,
    )
    return F.when((F.year(date) >= 2000) & (F.year(date) <= F.year(as_of) + years_ahead), date)


def days_until(date: Column, as_of: Column) -> Column:
    return F.datediff(date, as_of)
