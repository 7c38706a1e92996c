"""What a posting says of itself: when it was posted, how long the post lasts by its title, which kind of listing it is."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.deadlines import DATE, text_date
from harborline.functions.text import any_of, collapse, let, plain_words

# Fixed phrases: labels of the day of posting; terms of a title, the first that is named counts.
POSTED = ("date posted", "date posted by", "posting date", "date published", "publication date", "date de publication", "open date", "opening date", "advertised on", "posted on", "posted")
YEAR_DATE = DATE.removeprefix("(?i)").replace(r"(?:,? ?\d{4})?", r",? ?\d{4}")  # a date with its year
POSTED_DATE = rf"\b{any_of(POSTED)} ?(?:\([^()]*\))? ?[:–—-]? ?((?i:{YEAR_DATE}))"
RELATIVE = r"(?i)\bposted (?:(?:on ?)?posted )?(today|yesterday)(?:job requisition|time left|\b)"
TERMS = (("Term", "term"), ("Permanent", "permanent"), ("Continuing", "continuing"), ("Temporary", "temporary"), ("Contract", "contract"))
TERM_HEADS = ("part time", "parttime", "full time", "fulltime", "temporary", "contract", "casual", "seasonal", "permanent", "term")
TERM_ENDS = ("term", "permanent", "temporary", "contract")
SPAN = r"(?i)(?:(?:approximately|approx\.?|up to) )?\d+(?:\.\d+)? ?[-–—]? ?(?:year|month|week|day)s?(?: (?:contract|term|assignment|position))?"
TAIL = r"(?:^| [-–—,;] )([^-–—,;]+)$"

_pool = tuple(f"{a} {b}" for a in ("pool of", "pool of qualified") for b in ("candidate", "candidates"))
#: Kinds of listing: (kind, which text, phrases, what must follow in the same sentence, within how many characters). The
#: first rule that holds decides. A space in a phrase stands for white space or a hyphen.
FUTURE = ("future opportunities", "future vacancies", "future openings")
KINDS = (
    ("inventory", "title", ("applicant pool", "eligibility list", "inventory", "talent pool", "periodic"), (), 0),
    ("inventory", "text", ("not applying for a specific job", "not applying for a specific position"), ("inventory",), 120),
    ("inventory", "text", ("to an inventory", "inventory for future vacancies", "this pool may be used to staff", *(f"{p} will be established" for p in _pool)), (), 0),
    ("inventory", "text", ("inventory for future",), ("hiring", "vacancies", "opportunities"), 100),
    ("inventory", "text", ("staff current and future vacancies",), ("inventory",), 200),
    ("inventory", "text", tuple(f"this {b}{c}process" for b in ("", "is a ", "is an ", "anticipatory ", "is an anticipatory ") for c in ("", "staffing ")), ("inventory",), 160),
    ("inventory", "text", ("selection process",), ("inventory",), 120),
    ("inventory", "text", tuple(f"{v} {a}pool of {c}" for v in ("build", "building", "create", "creating", "establish", "established", "establishing", "maintain", "maintained", "maintaining") for a in ("", "a ") for c in ("candidate", "candidates")), (), 0),
    ("inventory", "text", tuple(f"{a} current and future {b}{c}{d}" for a in ("all", "both") for b in ("", "permanent ") for c in ("", "part time ") for d in ("vacancy", "vacancies")) + ("vacancy type: this is for all current and future",), (), 0),
    ("ongoing_recruitment", "title", ("ongoing recruitment", "recruitment program", "student employment program", "candidate pool", "hiring pool", "future opportunities", "expression of interest", *(f"co op {s}{m} {v}" for s in ("student", "students") for m in (" -", " –", " —", ":") for v in ("various", "multiple"))), (), 0),
    ("ongoing_recruitment", "text", ("candidate pool", "talent pool", "general recruitment call", "standing job posting", "current and future opportunities", "future opportunities that become available", "does not correspond to an immediate vacancy", "filled on an as needed basis", "this recruitment may be utilized for future opportunities"), (), 0),
    ("ongoing_recruitment", "text", _pool, FUTURE, 120),
    ("ongoing_recruitment", "text", ("application", "applications", "applicant", "applicants", "posting", "position", "role"), ("kept on file", *FUTURE), 180),
    ("ongoing_recruitment", "text", ("accept applications", "accepts applications", "accepting applications", "accept application", "accepts application", "accepting application"), ("throughout the year",), 120),
    ("ongoing_recruitment", "text", ("recruitment need", "recruitment needs", "recruitment for"), ("throughout the year", "all the year"), 120),
    ("ongoing_recruitment", "text", tuple(f"{p} {x}" for p in ("position", "role", "posting") for x in ("funded through", "part of", "eligible for", "eligibility for")), ("student employment program",), 100),
    ("ongoing_recruitment", "text", ("is hiring", "are hiring", "is recruiting", "are recruiting"), ("dispatch", "dispatcher", "dispatchers", "dispatching"), 160),
    ("ongoing_recruitment", "text", ("recruiting goal", "recruiting goals"), ("accepting application", "accepting applications", "future event", "future events"), 160),
    ("ongoing_recruitment", "text", ("co op student", "co op students"), ("various position", "various positions", "multiple position", "multiple positions"), 80),
    ("ongoing_recruitment", "text", ("pool to be created",), ("yes",), -120),  # over line ends as well
)
STORED_KINDS = (
    ("inventory", ("inventory", "candidate inventory", "talent inventory", "inventory process")),
    ("ongoing_recruitment", ("ongoing recruitment", "ongoing", "standing", "standing posting", "open till filled", "open until filled", "candidate pool", "talent pool", "recruitment program")),
)


def kind_pattern(phrases, after, within: int) -> str:
    """The pattern of a rule of ``KINDS``."""
    space = r"[\s-]+"
    if not after:
        return rf"\b{any_of(phrases, space)}\b"
    return rf"\b{any_of(phrases, space)}\b{rf'[^.\n]{{0,{within}}}' if within > 0 else rf'[\s\S]{{0,{-within}}}'}\b{any_of(after, space)}\b"


def posted_date(text: Column, as_of: Column) -> Column:
    """The first real date, with its year, behind a label of posting; at most a year ahead of ``as_of``."""
    found = F.regexp_extract_all(collapse(text), F.lit(POSTED_DATE), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: text_date(x, as_of, 1)), lambda x: x.isNotNull()), F.lit(0))


def recently_posted(text: Column, as_of: Column) -> Column:
    """``as_of`` for "posted today", the day before for "posted yesterday"; null for older and without any."""
    word = F.lower(F.regexp_extract(collapse(text), RELATIVE, 1))
    return F.when(word == "today", as_of).when(word == "yesterday", F.date_sub(as_of, 1))


def title_duration(title: Column) -> Column:
    """A span or a kind of term that stands in brackets, behind the last mark, or at the end of a title; null without."""

    def found(t: Column) -> Column:
        asides = F.concat_ws(
            " ", F.array_join(F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1)), " "), F.regexp_extract(t, TAIL, 1),
            F.when(t.rlike(rf"^{any_of(TERM_HEADS, '[ -]?')} ?[,;] ?."), t), F.regexp_extract(t, rf"\b({any_of(TERM_ENDS)})$", 1),
        )
        named = lambda a: let(plain_words(a), lambda w: F.coalesce(*(F.when(w.contains(f" {p} "), label) for label, p in TERMS)))
        return let(asides, lambda a: F.coalesce(F.nullif(F.trim(F.regexp_extract(a, SPAN, 0)), F.lit("")), named(a)))

    return let(collapse(title), found)


def listing_kind(title: Column, text: Column, inventory: Column) -> Column:
    """inventory, ongoing_recruitment or regular, by the flag, else by the first rule of ``KINDS`` that holds in the
    title, or in title and text."""
    name = F.coalesce(title, F.lit(""))
    both = F.concat(name, F.lit("\n"), F.coalesce(text, F.lit("")))
    rules = ((kind, (name if where == "title" else both).rlike(kind_pattern(*rule))) for kind, where, *rule in KINDS)
    return F.coalesce(F.when(inventory, "inventory"), *(F.when(hit, kind) for kind, hit in rules), F.lit("regular"))


def stored_kind(value: Column, inventory: Column) -> Column:
    """The kind that a stored value means, by its synonyms; regular for any other."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[\s_-]+", " "))
    return F.coalesce(F.when(inventory, "inventory"), *(F.when(t.isin(*names), kind) for kind, names in STORED_KINDS), F.lit("regular"))
