"""Lists of software: one name for each product, and skills that only repeat them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.requirements import SOFTWARE, line_words
from harborline.functions.text import collapse, let, plain_words

_apps = lambda *names: tuple(n + tail for n in names for tail in ("", " application", " applications"))
# Names with the whole values, as words, that stand for them.
PRODUCTS = (
    ("Microsoft Office", _apps("microsoft office", "microsoft office suite", "microsoft suite", "ms office", "ms office suite", "office 365")), ("Microsoft 365", _apps("microsoft 365", "m365")),
    *((name, _apps(f"microsoft {name.lower()}", f"ms {name.lower()}")) for name in ("Word", "Excel", "PowerPoint", "Outlook", "Access", "Visio", "Project")),
    ("Adobe Acrobat", ("acrobat", "acrobat pro", "adobe acrobat", "adobe acrobat pro", "adobe pro", "pro")), ("Adobe Creative Cloud", ("adobe creative cloud",)),
    *((name, (name.lower(), f"adobe {name.lower()}")) for name in ("Photoshop", "Illustrator", "InDesign")), ("Adobe Captivate", ("captivate", "adobe captivate")),
)


def software_names(values: Column) -> Column:
    """The names of all values in order, each once; unknown values stay as they are, without a last full stop."""
    table = F.create_map(*(x for name, spelt in PRODUCTS for p in spelt for x in (F.lit(p), F.lit(name))))
    name = lambda v: let(collapse(F.regexp_replace(collapse(v), r"\.$", "")), lambda t: F.coalesce(F.try_element_at(table, F.trim(plain_words(t))), t))
    return F.array_distinct(F.filter(F.transform(values, name), lambda x: x != ""))


def software_key(value: Column) -> Column:
    """The first product of the vocabulary that a value names, else its words."""

    def key(words: Column) -> Column:
        named = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.array(*(F.lit(f" {p} ") for p in phrases)).alias("phrases")) for n, phrases in SOFTWARE)), lambda e: F.exists(e["phrases"], lambda p: F.contains(words, p)))
        return F.coalesce(F.lower(F.get(named, F.lit(0))["name"]), F.trim(plain_words(value)))

    return let(line_words(value), key)


def skills_beside(skills: Column, software: Column) -> Column:
    """The skills that name no product which ``software`` names too."""
    keys = F.transform(F.coalesce(software, F.array().cast("array<string>")), software_key)
    return let(keys, lambda known: F.filter(skills, lambda s: ~F.array_contains(known, software_key(s))))
