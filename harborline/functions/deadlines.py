"""Closing dates, start dates and pay in free text, by tables of matches.

A text's dates and labels are found once, each with its place. Pairs of a label and a date behind it, with what
stands between, then meet a list of families: which labels, and what may stand between. The first family with a real date
decides. Start dates and pay look at what stands around a match.
"""
from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.dates import normalize_date
from harborline.functions.text import collapse, has_phrase, let, mentions, plain_words

MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
WEEKDAY = r"(?:(?:mon|tues|tue|wednes|wed|thurs|thu|fri|satur|sat|sun)(?:day)?\.?,? )?"
DATE = rf"(?i)\b{WEEKDAY}(?:{MONTH}\.?,? ?\d{{1,2}}(?:st|nd|rd|th)?(?:,? ?\d{{4}})?|\d{{4}} ?[/-] ?\d{{1,2}} ?[/-] ?\d{{1,2}}|\d{{1,2}} ?[/-] ?\d{{1,2}} ?[/-] ?\d{{2,4}}|\d{{1,2}}[-/ ]{MONTH}[-/ ,]+\d{{2,4}})\b"

_spelt = lambda *parts: tuple(" ".join(x for x in p if x) for p in product(*parts))
# Fixed phrases: labels, the first words of a sentence on applying, and the longest distance to a date.
DIRECT = (
    "posting end date", "post end date", "posting closing date", "external closing date", "job closing date", "closing date", "closing date internal", "closing date external", "date closed", "close date",
    "closing deadline", "application deadline", "apply by", "apply before", "please apply by", "last date to apply", "last day to apply", "posting close", "posting closes", "posting closed", "deadline", "deadline to apply", "deadline expires",
    *_spelt(("application", "applications"), ("must be received",), ("", "by")),
)
CLOSES = _spelt(("application",), ("close", "closes", "closed"))
SUBMIT = _spelt(("submit", "send"), ("", "your", "their", "our", "a", "an", "the"), ("application", "resume", "submission"))
RECEIVED = _spelt(("application", "applications", "resume", "resumes", "submission", "submissions"), ("", "must be"), ("received", "submitted", "sent"), ("by", "before"))
ENDING = _spelt(("posting", "position", "competition", "job", "job competition"), ("", "will"), ("close", "closes", "closed", "end", "ends", "ended", "expire", "expires", "expired"))
NEXT_TO = r"^ ?[:-]? ?$"
#: (labels, what may stand between label and date, whether the month is written with a dot), in the order in which they decide.
FAMILIES = (
    (("job closing date",), r"^ ?\( ?$", False),
    (DIRECT, r"^(?: ?\([^)]*\))? ?[:-]? ?$", False),
    (CLOSES, NEXT_TO, False),
    ((*CLOSES, "deadline", "deadline to apply", "closing date", "close date"), NEXT_TO, True),
    (SUBMIT, r"^.{0,100}\bby $", None),
    (("expire", "expires", "expire on", "expires on"), NEXT_TO, None),
    (("posting end date",), r"^.{0,80}\b(?:to|through) $", None),
    (("close date", "closing date"), r"^.{0,160}\bon $", None),
    (("closing date",), r"^(?: of)? ?:? ?$", None),
    (("deadline", "application deadline"), r"^.{0,100}\b(?:is|on|by|of) $", None),
    (RECEIVED, r"^ ?$", None),
    (ENDING, r"^.{0,120}\b(?:on|by) $", None),
    (("apply", "apply online"), r"^.{0,100}\bby $", None),
    (("apply by",), r"^.{0,160}\bon $", None),
    (("time left to apply",), r"^.{0,100}\bend date ?[:-]? ?$", None),
    (("posting period",), r"^ ?[:-]? ?.{6,40} (?:to|through|[-–—]) $", None),
)
REACH = 170
ALL_LABELS = tuple(sorted({x for labels, _, _ in FAMILIES for x in labels}, key=lambda x: (-len(x), x)))
LABEL = r"(?i)\b(?:" + "|".join(map(re.escape, ALL_LABELS)) + r")\b"


def _tree(phrases) -> str:
    """A pattern for any of the phrases, the longest first, that reads what several begin with once."""
    root: dict = {}
    for p in phrases:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [re.escape(c) + pattern(below) for c, below in node.items() if c]
        return f"(?:{'|'.join(parts)}){'?' if '' in node else ''}" if parts else ""

    return pattern(root)


def _quick(alternatives: str) -> str:
    return _tree(alternatives.split("|"))


# The same matches as ``LABEL`` and ``DATE`` give; most places in a text end at their first character.
QUICK_LABEL = rf"(?i)\b(?=[{''.join(sorted({x[0] for x in ALL_LABELS}))}]){_tree(ALL_LABELS)}\b"
_DAYS = "mon|tues|tue|wednes|wed|thurs|thu|fri|satur|sat|sun"
QUICK_DATE = DATE.replace(MONTH, _quick(MONTH[3:-1])).replace(f"(?:{_DAYS})", _quick(_DAYS)).replace(r"\b", r"\b(?=[0-9jfmasondtw])", 1)
# Fixed phrases of postings without a date, as words.
OPEN = (
    *_spelt(("until",), ("", "position is", "positions are", "position are", "positions is", "all positions are", "all position is", "the position is", "the position has been", "it is", "it has been"), ("filled",)),
    *_spelt(("open", "ongoing", "remain open", "accepting applications", "applications accepted"), ("till", "through"), ("", "position is", "positions are", "all positions are", "the position is", "vacancies are", "roles are", "role is", "job is", "jobs are", "vacancy is"), ("filled",)),
    *_spelt(("open until", "ongoing until"), ("", "a"), ("suitable candidate found",)), *_spelt(("open until",), ("", "all"), ("vacancies are", "roles are", "role is", "job is", "jobs are"), ("filled",)),
    *_spelt(("closing date", "external date", "job date", "posting date", "posting end date"), ("ongoing",)),
)
OPEN_ENDS = tuple(dict.fromkeys(p.split(" ")[-1] for p in OPEN))
NO_DATE = (
    *_spelt(("no", "without"), ("", "application", "closing", "application closing"), ("deadline",)), *_spelt(("no", "without"), ("closing", "application"), ("date",)),
    *_spelt(("deadline",), ("", "is"), ("not listed", "not specified", "unavailable")),
    *_spelt(("closing date",), ("job description", "application posted", "pcc", "openings", "back", "share", "apply now", "all qualified candidates", "experience the", "take on", "imagine", "days of work", "standard hours")),
)
NO_VALUE = ("tbd", "n/a", "na", "not available", "not listed", "not specified", "none", "unknown")
INVALID = r"(?i)^(?: ?\([^)]*\))? ?[:-] ?(?:(?:" + "|".join(NO_VALUE) + r")\b|[-–—]|\d{2,6} ?[/-] ?\d{1,2} ?[/-] ?\d{1,4}\b)"

START = (*_spelt(("expected", "anticipated", "target", "position", "employment", "work"), ("start date",)), "starting date", "commencement date", "start date")
START_LABEL = r"(?i)\b(?:" + "|".join(START) + r")\b"
START_NOISE = ("prior to", "before", "after", "from the", "automatic", "provide", "cover letter", "resume", "and end date")
NEXT_FIELD = ("end date", "length of", "job type", "work end", "posting", "number of", "pay range")
SEASON = "(?:fall|winter|spring|summer)"
START_VALUE = rf"(?i)^(?:immediate|asap|{SEASON}(?: semester)? \d{{4}}|{MONTH},? \d{{4}}\b|{DATE.removeprefix('(?i)')})"

PAY_WORDS = ("salary", "wage", "pay", "rate", "compensation", "hourly", "annual", "per hour", "per year")
_NUMBER = r"\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
MONEY = rf"(?i)\$ ?{_NUMBER}(?: ?[-–—] ?\$? ?{_NUMBER})?(?: ?(?:/|per) ?(?:hour|hr|year|yr|month|mo|week|day)| ?(?:hourly|annual|yearly|bi[- ]?weekly))?"
AROUND = 100


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the matches of ``pattern``, which takes one character at least; places
    count characters from 0."""
    item = "array<struct<start:int,end:int,text:string>>"
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    return F.aggregate(F.filter(both, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {item})").alias("out")), step, lambda acc: acc["out"])


def text_date(value: Column, as_of: Column, years_ahead: int) -> Column:
    """The date that a match of ``DATE`` stands for; without a year it lies in that of ``as_of``."""
    dated = lambda x: F.coalesce(normalize_date(x["t"], as_of, years_ahead), normalize_date(x["year"], as_of, years_ahead))
    named = lambda t: F.when(t.rlike("[A-Za-z]"), F.regexp_replace(t, "/", "-")).otherwise(t)
    both = lambda t: F.struct(t.alias("t"), F.concat(t, F.lit(", "), F.year(as_of).cast("string")).alias("year"))
    return let(let(let(F.regexp_replace(F.regexp_replace(value, r" ?([/-]) ?", "$1"), r"([A-Za-z])[.,]+ ?", "$1 "), named), both), dated)


def _accepted(labels) -> list[str]:
    """Labels of the table that hold one of ``labels`` at their begin or end."""
    return [x for x in ALL_LABELS if any(x == y or x.endswith(" " + y) or x.startswith(y + " ") for y in labels)]


def _fits(labels, gap: str, dot: bool | None):
    """Whether a pair is of a family."""
    accepted = _accepted(labels)
    return lambda p: p["label"].isin(accepted) & p["gap"].rlike("(?i)" + gap) & (F.lit(True) if dot is None else p["dot"] == dot)


def _closing_date(t: Column, as_of: Column) -> Column:
    def pairs(v: Column) -> Column:
        def behind(label: Column) -> Column:
            near = F.filter(v["dates"], lambda d: (d["start"] >= label["end"]) & (d["start"] - label["end"] <= REACH) & d["date"].isNotNull())
            return F.transform(near, lambda d: F.struct(F.lower(label["text"]).alias("label"), F.substring(v["t"], label["end"] + 1, d["start"] - label["end"]).alias("gap"), d["date"].alias("date"), d["text"].rlike(r"[A-Za-z]\.").alias("dot")))

        return F.flatten(F.transform(v["labels"], behind))

    def first(found: Column) -> Column:
        return F.coalesce(*(F.get(F.filter(found, _fits(*family)), F.lit(0))["date"] for family in FAMILIES))

    dates = F.transform(matches(t, QUICK_DATE), lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), text_date(m["text"], as_of, 5).alias("date")))
    return let(F.struct(t.alias("t"), dates.alias("dates"), matches(t, QUICK_LABEL).alias("labels")), lambda v: let(pairs(v), first))


def closing(text: Column, as_of: Column) -> Column:
    """struct<date, status> of a text's deadline: known with its date, else open_until_filled, not_listed, invalid (a
    label with a value that is none, or a malformed date) or not_checked. Null and empty texts are not_checked."""

    def judged(t: Column) -> Column:
        words = plain_words(t)
        bad = F.exists(matches(t, QUICK_LABEL), lambda m: F.substring(t, m["end"] + 1, F.lit(80)).rlike(INVALID))
        status = lambda date: F.when(date.isNotNull(), "known").when(t == "", "not_checked").when(mentions(t, OPEN_ENDS) & has_phrase(words, OPEN), "open_until_filled").when(has_phrase(words, NO_DATE), "not_listed").when(bad, "invalid").otherwise("not_checked")
        return let(F.struct(_closing_date(t, as_of).alias("date")), lambda x: F.struct(x["date"].alias("date"), status(x["date"]).alias("status")))

    return let(collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{200B}-\x{200D}\x{FEFF}]", "")), judged)


def start_value(value: Column, as_of: Column) -> Column:
    """ISO date, ``Immediate``, ``Fall 2027`` or ``October 2027``; null for anything else."""
    season, month = rf"(?i)^({SEASON})(?: semester)? (\d{{4}})$", rf"(?i)^({MONTH}),? (\d{{4}})$"
    titled = lambda p: F.concat(F.initcap(F.lower(F.regexp_extract(value, p, 1))), F.lit(" "), F.regexp_extract(value, p, 2))
    return F.when(F.lower(value).isin("immediate", "asap"), "Immediate").when(value.rlike(season), titled(season)).when(value.rlike(month), titled(month)).otherwise(text_date(value, as_of, 3).cast("string"))


def start_date(text: Column, as_of: Column) -> Column:
    """When the work begins: what stands behind a label. A bare ``start date`` near words on other dates doesn't count,
    nor does a label before another field; ``start date is`` goes first. Null without one."""

    def found(t: Column) -> Column:
        def at(m: Column) -> Column:
            after = F.regexp_replace(F.substring(t, m["end"] + 1, F.lit(100)), r"(?i)^ ?(?:will be|is|of|:|-) ?", "")
            begin = F.greatest(m["start"] - 40, F.lit(0))
            around = plain_words(F.substring(t, begin + 1, m["end"] + 20 - begin))
            noisy = (F.lower(m["text"]) == "start date") & has_phrase(around, START_NOISE)
            other = F.exists(F.array(*map(F.lit, NEXT_FIELD)), lambda p: F.startswith(F.lower(F.ltrim(after)), p))
            value = F.when(~other, start_value(F.regexp_extract(F.ltrim(after), START_VALUE, 0), as_of))
            prose = F.substring(t, m["end"] + 1, F.lit(4)) == " is "
            return F.struct(F.when(prose & (F.endswith(F.lower(m["text"]), F.lit("start date"))), 0).otherwise(1).alias("rank"), m["start"].alias("start"), F.when(~noisy | prose, value).alias("value"))

        real = F.filter(F.transform(matches(t, START_LABEL), at), lambda x: x["value"].isNotNull())
        return F.get(F.array_sort(real), F.lit(0))["value"]

    return let(collapse(F.coalesce(text, F.lit(""))), found)


def pay_text(text: Column) -> Column:
    """The first amount or range of money with a word on pay within 100 characters on either side; null without."""

    def found(t: Column) -> Column:
        def paid(m: Column) -> Column:
            begin = F.greatest(m["start"] - AROUND, F.lit(0))
            around = F.lower(F.substring(t, begin + 1, m["end"] + AROUND - begin))
            return F.exists(F.array(*map(F.lit, PAY_WORDS)), lambda p: F.contains(around, p))

        return F.trim(F.get(F.filter(matches(t, MONEY), paid), F.lit(0))["text"])

    return let(collapse(F.coalesce(text, F.lit(""))), found)
