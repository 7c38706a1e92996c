"""Bullets of a description that only say again what a posting's structured values say.

A bullet in a section on requirements falls into clauses, a clause into words. A clause is covered where all its
words are those of a value, words that go with the value's field, or words that say nothing; and one at least is the
value's own. Covered clauses go; a bullet goes with its last clause, a heading with its last line. What a pass leaves
may repeat another bullet or empty another section, so passes follow until one changes nothing.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.sections import BULLET, SECTIONS, _bare, is_heading, without_repeats
from harborline.functions.terms import first_match
from harborline.functions.text import collapse, has_phrase, let, plain_words

#: Passes at most.
ROUNDS = 5
CLAUSE = r"\s*[;,]\s*(?:and\s+)?|\s+and\s+"
# Fixed words. One spelling for each of them.
SAME = {
    "license": "licence", "licenses": "licence", "licences": "licence", "drivers": "driver", "years": "year", "yrs": "year", "yr": "year", "months": "month", "languages": "language",
    "skills": "skill", "certificates": "certificate", "certification": "certificate", "certifications": "certificate", "certified": "certificate", "vehicles": "vehicle", "checks": "check",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
# Words that say nothing by themselves.
GENERAL = (
    "a", "an", "the", "of", "in", "with", "for", "to", "or", "and", "both", "is", "are", "be", "must", "have", "has", "hold", "possess", "you", "your", "s", "at", "least", "minimum", "required", "requirement",
    "requirements", "mandatory", "essential", "valid", "current", "strong", "good", "excellent", "proven", "demonstrated", "ability", "use", "using", "e", "g", "such", "as", "including", "from", "recognized", "equivalent",
)
# By field: words that go with its values, and whether its values cover a clause together.
FIELDS = {
    "language": (("language", "fluent", "fluency", "proficiency", "proficient", "spoken", "written", "oral", "verbal", "speak", "read", "write", "communicate", "communication", "official", "bilingual", "knowledge", "skill"), True),
    "software": (("software", "system", "systems", "application", "applications", "program", "programs", "tool", "tools", "proficiency", "proficient", "knowledge", "working", "computer", "skill", "experience", "ms", "microsoft", "office"), True),
    "skill": (("skill", "proficiency", "proficient", "knowledge", "experience", "speed"), True),
    "vehicle": (("driver", "licence", "class", "permit", "access", "own", "reliable", "vehicle", "car", "transportation", "insured", "insurance", "abstract", "drive", "maintain"), True),
    "security": (("security", "clearance", "screening", "reliability", "status", "check", "criminal", "record", "police", "vulnerable", "sector", "satisfactory", "obtain", "maintain"), True),
    "experience": (("experience", "related", "relevant", "progressive", "recent", "work", "over", "more", "than"), False),
    "education": (("education", "completion", "completed", "successful", "degree", "diploma", "university", "college", "post", "secondary", "program", "field", "related"), False),
    "licence": (("licence", "licensed", "registration", "registered", "member", "membership", "standing", "hold"), False),
    "certificate": (("certificate", "training", "course", "level", "holder"), False),
}
# A bullet with one of these wishes or compares; it stays.
OPTIONAL = ("asset", "assets", "preferred", "preferable", "preferably", "nice to have", "desirable", "an advantage", "other than", "different than")


def _words(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ")  # a constant: Spark splits it once


def tokens(c: Column) -> Column:
    """The distinct words of a clause, lower case, one spelling and number each."""
    same = F.str_to_map(F.lit(" ".join(f"{a}={b}" for a, b in SAME.items())), F.lit(" "), F.lit("="))
    raw = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9#]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.transform(raw, lambda w: F.coalesce(F.try_element_at(same, w), w)))


def _cover(values: Column, field: str, around, together: bool) -> Column:
    mine = F.transform(F.filter(values, lambda v: v["field"] == field), lambda v: tokens(v["value"]))
    if together:
        mine = F.when(F.size(mine) > 0, F.array(F.array_distinct(F.flatten(mine)))).otherwise(F.expr("CAST(array() AS array<array<string>>)"))
    return F.transform(mine, lambda t: F.struct(F.array_except(t, _words(GENERAL)).alias("core"), F.array_union(t, _words((*GENERAL, *around))).alias("all")))


def covers(values: Column) -> Column:
    """array<struct<core, all>> of ``values`` (array<struct<field, value>>): what a clause must share one word with,
    and the words that all of its own must be among. Unknown fields cover nothing."""
    return F.concat(*(_cover(values, field, around, together) for field, (around, together) in FIELDS.items()))


def _rest(raw: Column, groups: Column, idle: Column) -> Column:
    """A bullet without its covered clauses; null where nothing else is left."""
    body = collapse(F.regexp_replace(raw, BULLET, ""))

    def state(t: Column) -> Column:
        covered = F.exists(groups, lambda g: (F.size(F.array_except(t, g["all"])) == 0) & F.arrays_overlap(t, g["core"]))
        return F.when(covered, "covered").when(F.size(F.array_except(t, idle)) == 0, "idle").otherwise("other")

    def rebuilt(parts: Column) -> Column:
        left = F.array_join(F.transform(F.filter(parts, lambda p: p["state"] == "other"), lambda p: p["clause"]), ", ")
        named = F.concat(F.regexp_extract(raw, BULLET, 0), F.upper(F.substring(left, 1, 1)), F.substring(left, 2, F.length(left)))
        return F.when(~F.exists(parts, lambda p: p["state"] == "covered"), raw).when(left != "", named)

    clauses = F.filter(F.split(F.regexp_replace(body, r"[.]+$", ""), CLAUSE), lambda c: c != "")
    judged = F.transform(clauses, lambda c: F.struct(c.alias("clause"), state(tokens(c)).alias("state")))
    return F.when(has_phrase(plain_words(body), OPTIONAL), raw).otherwise(let(judged, rebuilt))


def _once(text: Column, groups: Column) -> Column:
    """One pass: bullets once, covered clauses, empty sections, blank lines."""

    def parts(v: Column) -> Column:
        """array<struct<head, lines>> with each section's lines after the cover."""
        heads = F.filter(F.sequence(F.lit(0), F.size(v["lines"]) - 1), lambda i: F.get(v["marks"], i).isNotNull())
        starts = F.when(F.get(v["marks"], F.lit(0)).isNull(), F.concat(F.array(F.lit(-1)), heads)).otherwise(heads)

        def section(start: Column, end: Column) -> Column:
            kind = F.coalesce(F.when(start >= 0, F.get(v["marks"], start)), F.lit("other"))
            body = F.slice(v["lines"], start + 2, end - start - 1)
            asks = kind.isin("required", "optional")
            done = F.filter(F.transform(body, lambda x: F.when(asks & x.rlike(BULLET), _rest(x, groups, v["idle"])).otherwise(x)), lambda x: x.isNotNull())
            return F.struct(F.when(start >= 0, F.get(v["lines"], start)).alias("head"), done.alias("lines"))

        return let(starts, lambda s: F.transform(s, lambda start, i: section(start, F.coalesce(F.get(s, i + 1), F.size(v["lines"])))))

    def joined(sections: Column) -> Column:
        flat = F.flatten(F.transform(sections, lambda s: F.when(s["head"].isNull(), s["lines"]).otherwise(F.concat(F.array(s["head"]), s["lines"]))))
        return F.array_join(flat, "\n")

    def cleaned(sections: Column) -> Column:
        full = F.filter(sections, lambda s: s["head"].isNull() | F.exists(s["lines"], lambda x: F.trim(x) != ""))
        tidy = F.regexp_replace(F.regexp_replace(joined(full), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
        return F.when(joined(sections) == text, text).otherwise(tidy)

    idle = F.array_union(_words(GENERAL), F.array_distinct(F.flatten(F.transform(groups, lambda g: F.array_except(g["all"], g["core"])))))
    marks = lambda lines: F.transform(lines, lambda x: F.when(is_heading(x), first_match(F.lower(collapse(_bare(x))), SECTIONS, "other")))
    lines = F.split(without_repeats(text), "\n")
    return let(let(lines, lambda ls: F.struct(ls.alias("lines"), marks(ls).alias("marks"), idle.alias("idle"))), lambda v: let(parts(v), cleaned))


def without_restatements(text: Column, values: Column, rounds: int = ROUNDS) -> Column:
    """``text`` without what ``values`` (array<struct<field, value>>) already say, after passes until one changes
    nothing, ``rounds`` at most. Null text is empty; null or no values leave repeated bullets to go only."""
    known = F.coalesce(values, F.expr("CAST(array() AS array<struct<field:string,value:string>>)"))
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("done"))

    def step(groups: Column):
        def next_of(acc: Column, _: Column) -> Column:
            return F.when(acc["done"], acc).otherwise(let(_once(acc["text"], groups), lambda t: F.struct(t.alias("text"), (t == acc["text"]).alias("done"))))

        return next_of

    return let(covers(known), lambda groups: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step(groups), lambda acc: acc["text"]))
