"""What a reader sees of one posting: a struct of short labels from a stored row, absent ones null."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions import pay
from harborline.functions.education import education_label
from harborline.functions.posting_checks import shown_date
from harborline.functions.posting_fields import joined
from harborline.functions.requirements import NUMBERS
from harborline.functions.terms import NO_UNION, NO_UNION_START
from harborline.functions.text import collapse, has_phrase, json_strings, let, plain_words

# Roles with the words of a title that show them, labels in front of a value, values that say nothing.
ROLES = (
    ("teaching_assistant", "Teaching assistant", ("teaching assistant", "academic assistant", "graduate assistant", "instructional assistant", "course assistant", "marker", "demonstrator", "tutor")),
    ("research_assistant", "Research assistant", ("research assistant",)), ("research_associate", "Research associate", ("research associate",)), ("postdoctoral", "Postdoctoral", ("postdoc", "postdoctoral", "post doc", "post doctoral")),
    ("faculty", "Faculty", ("professor", "lecturer", "sessional instructor", "faculty member")), ("academic_instructor", "Academic instructor", ("academic instructor", "course instructor", "teaching fellow")), ("course_staff", "Course staff", ("course coordinator", "course staff")),
)
LABELS = {
    "course": ("course", "course / project", "course/project", "course code", "course code / title", "course code/title", "project"), "workload": ("academic workload", "workload", "appointment amount", "appointment"),
    "office_hours": ("academic office hours", "office hours", "consultation hours", "student-contact hours", "student contact hours", "lab hours"),
    "supervisor": ("academic supervisor", "supervisor", "principal investigator", "pi", "supervising department", "supervising person"), "appointment_type": ("academic appointment type", "appointment type", "appointment"), "schedule": (),
}
PLACEHOLDERS = ("n/a", "na", "none", "null", "not applicable", "not specified", "unknown")
GENERIC = ("full-time", "full time", "fulltime", "part-time", "part time", "parttime", "temporary", "contract", "permanent", "casual", "seasonal", "occasional", "on-call", "on call", "oncall")
ONLY_HOURS = tuple(f"{kind} {h}" for kind in ("office", "consultation", "student-contact", "student contact", "lab") for h in ("hour", "hours"))
TERM = r"^(?i:fall|winter|spring|summer) \d{4}$"
UNITS = ((r"(?i)\bhrs?\b\.?", "hours"), (r"(?i)\bper *wks?\b", "per week"), (r"(?i) */ *(?:wks?|week)\b", " per week"), (r"(?i)\b(\d+(?:\.\d+)?) *fte\b", r"\1 FTE"))
TENURES = ((r"(?i)\btenure *-? *track\b", "Tenure-track"), (r"(?i)\blimited *-? *term\b", "Limited-term"), (r"(?i)\bsessional(?: faculty)?\b", "Sessional"))
NUMBER = rf"\d+|{'|'.join(NUMBERS)}"
# An experience: what leads it, where it is a definition, and openings that say nothing.
LEAD = rf"(?i)^(?:(?:(?:a )?minimum(?: of)?|at least) )?({NUMBER})(?: ?(?:-|–|—|to) ?({NUMBER}))? years?['’]?"
FINISHED = r"(?i)^(?:(?:\d+(?:\+|[–-]\d+)? *(?:years?|months?)|recent(?: \(within past \d+ years\))?|several years) — .|experience with\b)"
DEFINED = r"(?i)\bis defined as\b|^experience is defined\b"
WITHIN, OR_MORE = r"(?i)within the past (?:\w+ ?)?\(?(\d+)\)? ?years?", rf"(?i)\b({NUMBER})\)? ?\+? ?years? or more"
OPENINGS = r"(?i)^(?:experience(?: ?:)?(?: in| with| of| using)?(?: the)? |in (?:the )?)"
DURATION = r"(?i)^(?:(?:\d+(?:\+|[–-]\d+)? *(?:years?|months?)|several years)(?: —|$)|recent\b)"


def _swapped(c: Column, pairs) -> Column:
    return collapse(reduce(lambda x, p: F.regexp_replace(x, p[0], p[1].replace("\\", "$")), pairs, c))


def label_pattern(field: str) -> str:
    """A field's own labels in front of its value, with a colon or a hyphen behind."""
    return "(?i)^(?:" + "|".join(sorted(LABELS[field], key=len, reverse=True)) + ") ?[:-] ?"


def academic(value: Column, field: str) -> Column:
    """A field on an academic post: without its label, in usual units; null where it says nothing."""
    tidy = F.regexp_replace(collapse(value), "[–—]", "-")
    stated = F.when((tidy != "") & ~F.lower(tidy).isin(*PLACEHOLDERS), tidy)
    bare = F.trim(F.regexp_replace(stated, label_pattern(field), "")) if LABELS[field] else stated
    if field in ("workload", "office_hours"):
        bare = _swapped(bare, UNITS if field == "workload" else UNITS[:3])
    if field == "appointment_type":
        bare = let(_swapped(bare, TENURES), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))
    empty = {"course": bare.rlike(TERM), "workload": F.lower(bare).isin(*GENERIC), "appointment_type": F.lower(bare).isin(*GENERIC), "office_hours": F.lower(bare).isin(*ONLY_HOURS)}.get(field, F.lit(False))
    return F.when((bare != "") & ~empty, bare)


def academic_role(stored: Column, title: Column) -> Column:
    """Label of the stored role, else of the first role whose words the title holds."""
    named = F.coalesce(*(F.when(stored == key, label) for key, label, _ in ROLES))
    return F.coalesce(named, let(plain_words(title), lambda w: F.coalesce(*(F.when(has_phrase(w, words), label) for _, label, words in ROLES))))


def union_label(member: Column, name: Column) -> Column:
    """A union's name, ``Unionized`` where it is only called a union; null for none and for names that deny one."""

    def shown(s: Column) -> Column:
        denied = let(plain_words(s), lambda w: F.trim(w).isin(*NO_UNION) | F.exists(F.array(*(F.lit(f" {p} ") for p in NO_UNION_START)), lambda p: F.startswith(w, p)))
        return F.when((s != "") & ~denied, F.when(F.lower(s) == "union", "Unionized").otherwise(s))

    return F.when(member == 1, let(collapse(F.regexp_replace(F.trim(name), r"\?+$", "")), shown))


def start_label(value: Column) -> Column:
    """``Aug 4, 2026`` where the value begins with a real date, else the trimmed value; null for nothing."""
    day = F.substring(F.trim(value), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d\d-\d\d$") & day.try_cast("date").isNotNull(), shown_date(day)).otherwise(F.nullif(F.trim(value), F.lit("")))


def _digits(c: Column) -> Column:
    """A number in digits or by name, as digits."""
    return reduce(lambda x, i: F.when(F.lower(c) == NUMBERS[i], str(i + 1)).otherwise(x), range(len(NUMBERS)), c)


def experience_label(value: Column) -> Column:
    """An experience in short: its span first (``N+ years``, ``N–M years``), without openings that say nothing. A
    definition gives its span alone, or nothing. Alternatives keep their words."""

    def led(s: Column) -> Column:
        low, high = F.regexp_extract(s, LEAD, 1), F.regexp_extract(s, LEAD, 2)
        span = F.concat(_digits(low), F.when(high != "", F.concat(F.lit("–"), _digits(high))).otherwise("+"), F.lit(" years"))
        named = F.regexp_extract(s, rf"(?i)^({'|'.join(NUMBERS)}) years?\b", 1)
        alternative = F.when(named != "", F.concat(_digits(named), F.substring(s, F.length(named) + 1, F.length(s)))).otherwise(s)
        text = F.when(s.rlike(r"(?i)\bor\b"), alternative).when(low != "", F.concat(span, F.regexp_replace(s, LEAD, ""))).otherwise(s)
        short = F.regexp_replace(F.regexp_replace(F.concat(text, F.lit(" ")), OPENINGS, ""), r"[.;\s]+$", "")
        return let(F.trim(short), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))

    def label(s: Column) -> Column:
        within, more = F.regexp_extract(s, WITHIN, 1), F.regexp_extract(s, OR_MORE, 1)
        defined = F.when(within != "", F.concat(F.lit("Recent (within past "), within, F.lit(" years)"))).when(more != "", F.concat(_digits(more), F.lit("+ years"))).otherwise("")
        return F.when((s == "") | s.rlike(FINISHED), s).when(s.rlike(DEFINED), defined).otherwise(led(s))

    return let(collapse(value), label)


def experiences(values: Column) -> Column:
    """Labels by semicolon: the first span leads, further spans go, all others follow in order; null without one."""

    def ordered(found: Column) -> Column:
        span = lambda x: x["defined"] | x["label"].rlike(DURATION)
        parts = F.concat(F.slice(F.filter(found, span), 1, 1), F.filter(found, lambda x: ~span(x)))
        return F.nullif(F.array_join(F.transform(parts, lambda x: x["label"]), "; "), F.lit(""))

    labels = F.transform(values, lambda v: F.struct(experience_label(v).alias("label"), v.rlike(r"(?i)\bis defined as\b").alias("defined")))
    return let(F.filter(labels, lambda x: x["label"] != ""), ordered)


def details() -> Column:
    """The struct, from the columns of a stored row by their names; lists are JSON arrays, flags 0, 1 or null."""
    c, listed = F.col, lambda name, mapper=lambda x: x: joined(json_strings(F.col(name)), mapper)
    stated = lambda x: F.nullif(x, F.lit(""))
    listing = F.when(c("listing_type") == "ongoing_recruitment", "Ongoing recruitment").when((c("listing_type") == "inventory") | (c("is_inventory") == 1), "Candidate inventory")
    academics = [academic(c(f"academic_{f}"), f).alias(f) for f in LABELS if f != "workload"]
    fields = [
        pay.shown(c("salary_min"), c("salary_max"), c("salary_period")).alias("salary"), F.when(c("work_model") == "On-site", "In-person").otherwise(stated(c("work_model"))).alias("mode"), stated(c("employment_type")).alias("type"), stated(c("duration")).alias("duration"),
        start_label(c("start_date")).alias("start_date"), stated(c("hours")).alias("hours"), stated(c("availability")).alias("availability"),
        F.struct(academic_role(c("academic_role_type"), c("job_title")).alias("role"), F.coalesce(academic(c("academic_workload"), "workload"), academic(c("hours"), "workload")).alias("workload"), *academics).alias("academic"),
        union_label(c("is_unionized"), c("union_name")).alias("union"), listing.alias("listing"), F.when(c("is_student") == 1, "Yes").alias("student"),
        F.struct(
            experiences(json_strings(c("experience_requirements"))).alias("experience"), listed("education_requirements", lambda x: education_label(x)["label"]).alias("education"), listed("license_requirements").alias("licences"), listed("language_requirements").alias("languages"),
            F.when(c("vehicle_required") == 1, "Required").alias("vehicle"), F.when(c("security_check_required") == 1, "Required").alias("security"), listed("certification_requirements").alias("certifications"), listed("software_requirements").alias("software"),
            listed("medical_requirements").alias("medical"), listed("required_skills").alias("skills"),
        ).alias("requirements"),
        listed("benefits").alias("benefits"), F.when(F.lower(c("description")).contains("future requirements"), "Eligible for future requirements").alias("future"),
    ]
    return F.struct(*fields)
