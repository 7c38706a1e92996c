"""Lines and sections of Markdown descriptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.terms import first_match
from harborline.functions.text import collapse, let, once

# What a heading without marks may consist of.
NAME = r"^[A-Z][A-Za-z0-9 &'/-]{3,}$"
# Fixed section words, in the order in which they decide.
SECTIONS = (
    ("benefits", r"\b(?:compensation|benefits?|perks?|pension|total\s+rewards)\b"),
    ("optional", r"\b(?:nice\s+to\s+have|preferred|desirable|assets?|bonus|additional\s+qualifications)\b"),
    ("required", r"\b(?:qualifications?|requirements?|minimum|essential|what\s+you\s+(?:need|should)|skills?|education|training|language|licen[cs]e)\b"),
)
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"


_BLANK = " \t\n\x0b\f\r"


def _bare(raw: Column) -> Column:
    """A line without the marks of a heading around it."""
    return F.rtrim(F.ltrim(F.trim(raw), F.lit("#*" + _BLANK)), F.lit("*:" + _BLANK))


def _heads(raw: Column, line: Column) -> Column:
    """``is_heading`` of a line that is known as it stands and collapsed. Most lines hold a lower-case letter and no
    mark at an end, so they end at the first tests."""
    marked = F.startswith(line, F.lit("#")) | F.startswith(line, F.lit("*")) | F.endswith(line, F.lit(":")) | ~raw.rlike("[a-z]")

    def judged(bare: Column) -> Column:
        end = F.regexp_replace(line, r":$", "")
        starred = F.startswith(line, F.lit("*")) & F.endswith(end, F.lit("*")) & ~F.contains(bare, F.lit("*")) & ~line.rlike(r"^\*+\s")
        named = bare.rlike(NAME) & ~line.rlike("^[#*]") & (F.endswith(line, F.lit(":")) | (bare == F.upper(bare)))
        return (bare != "") & (line.rlike(r"^#{1,6}\s") | starred | named)

    return F.when(marked, let(_bare(raw), judged)).otherwise(F.lit(False))


def is_heading(raw: Column) -> Column:
    """Marked by number signs or by stars on both sides, or a name that is in capitals or ends in a colon."""
    return let(collapse(raw), lambda line: _heads(raw, line))


def _line(raw: Column) -> Column:
    """struct<is_heading, text> of one line."""

    def text(head: Column, line: Column) -> Column:
        unmarked = F.when(raw.rlike(BULLET), collapse(F.regexp_replace(raw, BULLET, ""))).otherwise(line)
        return F.when(head, F.lower(collapse(_bare(raw)))).otherwise(unmarked)

    return let(collapse(raw), lambda line: let(_heads(raw, line), lambda head: F.struct(head.alias("is_heading"), text(head, line).alias("text"))))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text, is_heading, section, heading): lines that aren't blank; a line's section is that of the last
    heading before it, ``other`` without one, and ``heading`` is its text. All of a line is computed within its array,
    so that no filter computes it again."""
    raw = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    rows = df.select(key, F.posexplode_outer(F.transform(raw, _line)).alias("line", "x")).select(key, "line", "x.text", "x.is_heading").filter("text <> ''")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("is_heading"), F.struct(first_match(F.col("text"), SECTIONS, "other").alias("section"), F.col("text").alias("heading")))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(before))
    return rows.select(key, "line", "text", "is_heading", F.coalesce("head.section", F.lit("other")).alias("section"), F.col("head.heading").alias("heading"))


def words_key(c: Column) -> Column:
    """Lower-case words of a line as one normal text."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def without_repeats(text: Column) -> Column:
    """``text`` without bullets that say the same as an earlier one."""
    key = lambda x: F.when(x.rlike(BULLET), words_key(F.regexp_replace(x, BULLET, "")))
    first = lambda keys: lambda _, i: let(F.get(keys, i), lambda k: k.isNull() | (F.array_position(keys, k) == i + 1))
    return let(F.split(text, "\n"), lambda raw: let(F.transform(raw, key), lambda keys: F.array_join(F.filter(raw, first(keys)), "\n")))  # else every line would make all keys anew


def narrower_bullets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line) of bullets whose words, two at least, all stand in another bullet of the same section
    (of two with the same words, the later one)."""
    words = F.array_distinct(F.filter(F.split(words_key(F.col("text")), " "), lambda w: F.length(w) > 2))
    rows = lines(df, key, text).filter("NOT is_heading").select(key, "section", "line", once(words).alias("words"))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.section") == F.col("b.section")) & (F.col("a.line") != F.col("b.line"))
    sizes = (F.size("a.words") < F.size("b.words")) | ((F.size("a.words") == F.size("b.words")) & (F.col("a.line") > F.col("b.line")))
    inside = same & (F.size("a.words") >= 2) & sizes & (F.size(F.array_except("a.words", "b.words")) == 0)
    return a.join(b, inside, "left_semi").select(key, "line")


def languages(values: Column) -> Column:
    """Distinct trimmed names: English, French, the others by name, Bilingual last."""
    rank = lambda x: F.when(x == "English", 0).when(x == "French", 1).when(x == "Bilingual", 3).otherwise(2)
    names = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(rank(x).alias("rank"), x.alias("name")))), lambda s: s["name"])
