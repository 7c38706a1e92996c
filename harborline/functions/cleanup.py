"""Markdown descriptions as arrays of sections, and what is cleaned in them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.text import let

# Fixed words: a section of nothing but these says nothing.
NOTHING = ("none", "n/a", "not applicable", "not specified", "not required")
NOTHING_START = "no additional "
# Fixed phrases: a wish that is none.
MANDATORY = ("to be considered for employment", "must be", "required to", "are required", "registered as a full-time", "eligible", "eligibility")


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def unbulleted(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^\s*[-•]\s*", ""))


def _bullet(line: Column) -> Column:
    return line.rlike(r"^\s*[-•]\s")


def _section(heading: Column, body: Column) -> Column:
    return F.struct(heading.alias("heading"), body.alias("body"))


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, body>>: a new section at each line with one to three number signs. What stands before
    the first has an empty heading; sections without either are left out, and null text has none."""
    chunks = F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^#{1,3}\s)")

    def parts(chunk: Column) -> Column:
        first = F.substring_index(chunk, "\n", 1)
        headed = first.rlike(r"^#{1,3}\s+\S")
        return F.when(headed, _section(strip(F.regexp_replace(first, r"^#{1,3}\s+", "")), strip(F.substring(chunk, F.length(first) + 1, F.length(chunk))))).otherwise(_section(F.lit(""), strip(chunk)))

    return F.filter(F.transform(chunks, parts), lambda s: (s["heading"] != "") | (s["body"] != ""))


def as_markdown(sections: Column) -> Column:
    """The text of the sections, with headings of the second level and blank lines between."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.when(s["heading"] != "", F.concat(F.lit("## "), s["heading"], F.lit("\n"))).otherwise(""), s["body"])), "\n\n")


def says_nothing(body: Column) -> Column:
    """Whether every line that isn't blank is a placeholder; an empty body counts."""
    said = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(F.lower(unbulleted(x)), r"\.$", "")), lambda x: x != "")
    return F.forall(said, lambda x: x.isin(*NOTHING) | F.startswith(x, F.lit(NOTHING_START)))


def without_placeholders(sections: Column) -> Column:
    """Sections under a heading go if they say nothing."""
    return F.filter(sections, lambda s: (s["heading"] == "") | ~says_nothing(s["body"]))


def mandatory_wishes_moved(sections: Column) -> Column:
    """Bullets below ``nice to have`` that are mandatory move to the end of the first section on qualifications,
    which is made if there is none; a section that loses all its lines goes."""
    nice = lambda s: F.contains(F.lower(s["heading"]), F.lit("nice to have"))
    must = lambda x: _bullet(x) & F.exists(F.array(*map(F.lit, MANDATORY)), lambda p: F.contains(F.lower(x), p))
    qualified = lambda s: F.contains(F.lower(s["heading"]), F.lit("qualif"))
    moved = F.flatten(F.transform(F.filter(sections, nice), lambda s: F.filter(F.split(s["body"], "\n"), must)))
    rest = F.filter(
        F.transform(sections, lambda s: F.when(nice(s), _section(s["heading"], strip(F.array_join(F.filter(F.split(s["body"], "\n"), lambda x: ~must(x)), "\n")))).otherwise(s)),
        lambda s: ~nice(s) | (s["body"] != ""),
    )

    def add(both: Column) -> Column:
        kept, extra = both["rest"], F.array_join(both["moved"], "\n")
        target = F.array_position(F.transform(kept, qualified), True)
        joined = F.transform(kept, lambda s, i: F.when(i + 1 == target, _section(s["heading"], strip(F.concat(s["body"], F.lit("\n\n"), extra)))).otherwise(s))
        return F.when(F.size(both["moved"]) == 0, kept).when(target > 0, joined).otherwise(F.concat(kept, F.array(_section(F.lit("Qualifications"), extra))))

    return let(F.struct(rest.alias("rest"), moved.alias("moved")), add)


def open_parenthesis(c: Column) -> Column:
    """Whether a parenthesis is still open where the text ends; null for null."""
    depth = F.aggregate(F.split(c, ""), F.lit(0), lambda d, x: F.when(x == "(", d + 1).when((x == ")") & (d > 0), d - 1).otherwise(d))
    return F.when(c.isNotNull(), depth > 0)


def json_state(c: Column) -> Column:
    """array, other (valid JSON of another kind), malformed, or empty."""
    v = F.try_parse_json(c)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(v.isNull(), "malformed").when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), "array").otherwise("other")


def known_tags(tags: Column, vocabulary: list[str]) -> Column:
    """The distinct tags that the vocabulary has, in its spelling and in the tags' order."""
    known = F.create_map(*[F.lit(x) for t in vocabulary for x in (t.lower(), t)])
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(known, F.lower(F.trim(t)))), lambda t: t.isNotNull()))
