"""Overviews without what advertises the employer's town, and descriptions without lines of page furniture.

A paragraph falls into sentences. One that speaks of the town and not of the work is an advertisement; a paragraph is
one if half of its sentences are and none speaks of the work or names the title.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.cleanup import strip
from harborline.functions.text import collapse, has_phrase, let, mentions, plain_words, stems

# Fixed phrases, as words.
TOWN = (
    "quality of life", "urban amenities", "raising a family", "never been a better time", "st lawrence river", "live work and play", "live working and play", "situated on the banks", "situated on the shores", "expanding population",
    "growing economy", "beautiful community", "beautiful city", "beautiful town", "known as the", "world class", "proud to call", "proud to be", "vibrant community", "vibrant city", "municipal services and infrastructure",
    "residents and partners feel safe", "excellent place for a career",
)
TOWN_NUMBERS = r" (?:population|community) of [0-9]"
WORK = (
    "responsible for", "this role", "this position", "this job", "the successful candidate", "reporting to", "duties include", "you will", "the incumbent", "assess", "assesses", "assessing", "coordinate", "coordinates", "manage", "manages",
    "provide", "provides", "support", "supports", "supporting", "lead", "leads", "leading", "oversee", "oversees", "overseeing", "deliver", "delivers", "delivering", "process", "processes", "processing",
)
OPENERS = ("your opportunity", "the opportunity", "about the role", "about the position", "what you'll do", "what you’ll do")
SITES = ("instagram", "facebook", "linkedin")
FURNITURE = ("apply now", "print", "share this page", "share the page", "cookie", "cookie policy", "cookie notice", *(f"{verb} us on {site}" for verb in ("find", "follow") for site in SITES))
EQUITY = (
    "equal opportunity employer", "equitable hiring and employment practices", "accommodation needs of persons with disabilities", "accommodation need of persons with disabilities", "inclusive and barrier-free work environment",
    "under-represented employment equity groups", "self-declare when you apply",
)
#: Characters that a title, and its part before a comma or dash, need to be looked for.
TITLE, HEAD = 4, 8
OPENER = "(?i)^(?:" + "|".join(OPENERS) + r")\s*:?[\s-]*"
OPENER_ALONE = "(?i)^(?:" + "|".join(OPENERS) + r")\s*:?[.!]?$"
SENTENCE = r'([.!?])\s+([A-Z0-9“"])'
FURNITURE_LINE = r"^(?:skip to .+|learn more about .+ on (?:" + "|".join(SITES) + ")|" + "|".join(FURNITURE) + r")\.?$"


def sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(paragraph, SENTENCE, "$1\u0001$2"), "\u0001"), strip), lambda s: s != "")


def _holds(low: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def _names_title(sentence: Column, title: Column) -> Column:
    named = lambda low: F.contains(low, title["core"]) | ((F.length(title["head"]) >= HEAD) & F.contains(low, title["head"]))
    return (F.length(title["core"]) >= TITLE) & let(F.lower(sentence), named)


#: What a sentence on the town mentions.
TOWN_STEMS = stems(TOWN, ("population", "community"))


def _advertises(sentence: Column) -> Column:
    town = lambda words: (has_phrase(words, TOWN) | words.rlike(TOWN_NUMBERS)) & ~has_phrase(words, WORK)
    return mentions(sentence, TOWN_STEMS) & let(plain_words(sentence), town)


def is_advertisement(paragraph: Column, title: Column) -> Column:
    """Whether half of the sentences, one at least, advertise and none is on the work. ``title``: struct<core, head>.
    Most paragraphs don't mention a town, so they don't fall into sentences here."""

    def judged(all_of: Column) -> Column:
        half = let(F.size(F.filter(all_of, _advertises)), lambda hits: (hits > 0) & (2 * hits >= F.size(all_of)))
        return half & ~F.exists(all_of, lambda s: _names_title(s, title) | has_phrase(plain_words(s), WORK))

    return mentions(paragraph, TOWN_STEMS) & let(sentences(paragraph), judged)


def _from_the_work_on(paragraph: Column, title: Column) -> Column:
    """From the first sentence that names the title on, or without leading advertisements where none does; an opener goes."""

    def cut(all_of: Column) -> Column:
        named = F.when(_names_title(paragraph, title), F.array_position(F.transform(all_of, lambda s: _names_title(s, title)), True))
        other = F.when(mentions(paragraph, TOWN_STEMS), F.array_position(F.transform(all_of, lambda s: ~_advertises(s)), True)).otherwise(1)
        start = F.when(named > 0, named).otherwise(other)
        rest = F.array_join(F.slice(all_of, F.greatest(start, F.lit(1)).cast("int"), F.size(all_of) + 1), " ")
        return F.when((F.size(all_of) == 0) | (start == 0), strip(paragraph)).otherwise(strip(F.regexp_replace(rest, OPENER, "")))

    return let(sentences(paragraph), cut)


def clean_overview(overview: Column, title: Column) -> Column:
    """``overview`` from its first paragraph on the work on, without advertisements; as it was where no sentence would
    be left. Null is empty; without a title only sentences decide."""

    def cleaned(v: Column) -> Column:
        core = v["title"]["core"]
        ad = F.transform(v["parts"], lambda p: is_advertisement(p, v["title"]))
        named = F.transform(v["parts"], lambda p: (F.length(core) >= TITLE) & (F.contains(F.lower(p), core) | F.contains(F.lower(p), v["title"]["head"])))
        leading = lambda x: F.when(F.array_position(x["ad"], False) > 0, F.array_position(x["ad"], False)).otherwise(F.size(v["parts"]) + 1)
        return let(F.struct(ad.alias("ad"), named.alias("named")), lambda x: kept(v, F.greatest(leading(x), F.array_position(x["named"], True)).cast("int")))

    def kept(v: Column, start: Column) -> Column:
        cut = lambda p: _from_the_work_on(p, v["title"])
        some = F.filter(F.transform(F.slice(v["parts"], start, F.size(v["parts"]) + 1), cut), lambda p: (p != "") & ~p.rlike(OPENER_ALONE) & ~is_advertisement(p, v["title"]))
        result = F.when(start > F.size(v["parts"]), F.coalesce(F.nullif(cut(F.get(v["parts"], F.size(v["parts"]) - 1)), F.lit("")), v["whole"])).otherwise(F.array_join(some, "\n\n"))
        return let(result, lambda r: F.when((start > F.size(v["parts"])) | r.rlike(r"[.!?](?:\s|$)"), r).otherwise(v["whole"]))

    core = F.lower(collapse(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\([^)]*\)\s*$", "")))
    whole = strip(F.coalesce(overview, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, r"\n\s*\n+"), strip), lambda p: p != "")
    head = let(core, lambda c: F.struct(c.alias("core"), F.trim(F.regexp_extract(c, "^[^,–—-]*", 0)).alias("head")))
    given = F.struct(whole.alias("whole"), parts.alias("parts"), head.alias("title"))
    return let(given, lambda v: F.when(F.size(v["parts"]) == 0, v["whole"]).otherwise(cleaned(v)))


def without_furniture(body: Column) -> Column:
    """``body`` without lines of navigation and social sites, and without paragraphs on equity."""
    said = lambda x: F.lower(strip(F.regexp_replace(x, r"^\s*[-•]\s*", "")))
    lines = lambda p: strip(F.array_join(F.filter(F.split(p, "\n"), lambda x: ~said(x).rlike(FURNITURE_LINE)), "\n"))
    parts = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\n\s*\n+"), lines), lambda p: (p != "") & ~_holds(F.lower(p), EQUITY))
    return F.array_join(parts, "\n\n")
