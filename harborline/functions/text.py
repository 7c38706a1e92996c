"""Text functions as column expressions. White space includes the no-break space, as in scraped pages."""
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+"
#: All characters of ``SPACE`` but the plain space are among these; most texts hold none.
_UNUSUAL = r"[^ -~\x{00A1}-\x{1FFF}]"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a generated column, one to a row: a filter on it doesn't make Spark compute it a second time."""
    return F.explode_outer(F.array(value))


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces and cut at both ends; null stays null."""
    return let(c, lambda v: F.trim(F.when(F.contains(v, F.lit("  ")) | v.rlike(_UNUSUAL), F.regexp_replace(v, SPACE, " ")).otherwise(v)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def placeholder_to_null(c: Column) -> Column:
    """The trimmed value, or null for empty text and the words null, NULL and N/A."""
    t = F.trim(c)
    return F.when(~t.isin("", "null", "NULL", "N/A"), t)


def slug(c: Column) -> Column:
    """Lower case, dots and apostrophes dropped, other runs of marks as one hyphen."""
    s = F.regexp_replace(F.lower(c), r"[.']", "")
    return F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fix_case(c: Column) -> Column:
    """Text in capitals only becomes title case."""
    return F.when((c == F.upper(c)) & (c != F.lower(c)), F.initcap(F.lower(c))).otherwise(c)


def url_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def stable_hash(c: Column) -> Column:
    """32-bit FNV-1a over the characters of ASCII text."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.when(c.isNull(), None).otherwise(F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295))))


def number(c: Column) -> Column:
    """The numeric prefix once $, commas and spaces are gone, as double; null without one."""
    return F.regexp_extract(F.regexp_replace(c, r"[$,\s]", ""), r"^[-+]?\d*\.?\d+", 0).try_cast("double")


def flag(c: Column) -> Column:
    """1, 0 or null from the usual spellings; anything else is null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "required"), 1).when(t.isin("0", "false", "no", "n", "not required", "none"), 0)


def json_strings(c: Column) -> Column:
    """The string elements of a JSON array; an empty array for anything else."""
    v = F.try_parse_json(c)
    is_array = F.schema_of_variant(v).startswith("ARRAY")
    parts = F.filter(F.when(is_array, v.cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(parts, lambda x: x.cast("string")), F.array().cast("array<string>"))


def string_list(c: Column) -> Column:
    """Parts between commas and semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def plain_words(c: Column) -> Column:
    """Lower-case words and numbers with one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_phrase(words: Column, phrases) -> Column:
    """Whether ``words`` (see ``plain_words``) hold one of the phrases, as whole words."""
    return let(words, lambda w: F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.contains(w, p)))  # else every phrase would make the words anew


def mentions(text: Column, parts) -> Column:
    """Whether the lower-case ``text`` holds one of ``parts``, also within words: a cheap test before words are made."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in dict.fromkeys(parts))))


def stems(*phrases) -> tuple[str, ...]:
    """The longest run of letters and digits of each phrase, for ``mentions``: no text has the phrase without it."""
    longest = sorted({max(re.findall(r"[\w#]+", p), key=len) for group in phrases for p in group})
    return tuple(x for x in longest if not any(y != x and y in x for y in longest))


def any_of(phrases, space: str = r"\s+") -> str:
    """A pattern for any of the phrases, the longest first, in either case; ``space`` stands between their words."""
    return "(?i:" + "|".join(space.join(re.escape(w).replace("\\-", "-") for w in p.split(" ")) for p in sorted(phrases, key=len, reverse=True)) + ")"


def branching(words) -> str:
    """A pattern for any of the words in which common beginnings are read once; a plain list is tried word by word at
    every place of a text."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + branching(by[c]) for c in sorted(by) if c]
    optional = "?" if "" in by else ""
    return f"(?:{'|'.join(parts)}){optional}" if parts and (optional or len(parts) > 1) else "".join(parts)
