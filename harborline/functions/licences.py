"""Licences and registrations in the lines of a description, as short labels.

A line falls into clauses where a separator stands outside all brackets. A clause on driving gives classes,
endorsement and province; any other gives a role and the body that registers it. Of a posting's labels those go that
another one says more of.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.deadlines import matches
from harborline.functions.requirements import OPTIONAL, line_words
from harborline.functions.text import has_phrase, let, stems

# Classes, provinces, roles and bodies; phrases are those of ``line_words``, the more specific first.
CLASSES = ("G", "G1", "G2", "A", "B", "C", "D", "E", "F", "1", "2", "3", "4", "5", "6", "AZ", "BZ", "CZ", "DZ", "EZ", "FZ", "MZ")
PROVINCES = (("Ontario", ("ontario", "mto")), ("BC", ("british columbia", "bc")), ("Alberta", ("alberta",)), ("Manitoba", ("manitoba",)), ("Saskatchewan", ("saskatchewan",)), ("Nova Scotia", ("nova scotia",)))
ROLES = (
    ("Nurse Practitioner (RN-EC)", ("registered nurse in the extended class", "nurse practitioner", "rn ec")), ("Registered Practical Nurse (RPN)", ("registered practical nurse", "licensed practical nurse", "rpn", "lpn")),
    ("Registered Nurse (RN)", ("registered nurse", "rn")), ("P.Eng.", ("professional engineer", "professional engineering", "p.eng", "p eng", "peng")), ("EIT", ("engineering intern", "eit")),
    ("CET", ("certified engineering technologist", "c.e.t", "cet")), ("RPP", ("registered professional planner", "rpp")), ("CPA", ("chartered professional accountant", "cpa")), ("Psychotherapist", ("psychotherapist",)),
    ("Lawyer", ("lawyer", "barrister", "solicitor")), ("MLT", ("medical laboratory technologist", "mlt")), ("Landscape Architect", ("landscape architect",)), ("Architect (OAA)", ("professional architect", "oaa")),
)
BODIES = (
    ("CNO", ("college of nurses", "college of nurses of ontario", "ontario college of nurses", "cno")), ("CRNA", ("college of registered nurses of alberta", "crna")), ("CRNS", ("college of registered nurses of saskatchewan", "crns")),
    ("PEO", ("professional engineers ontario", "professional engineers of ontario", "peo")), ("EGBC", ("engineers and geoscientists bc", "engineers and geoscientists british columbia", "engineers and geoscientists of british columbia", "egbc")), ("EGM", ("engineers geoscientists manitoba", "egm")),
    ("CPSO", ("college of physicians and surgeons of ontario", "cpso")), ("CASLPO", ("college of audiologists and speech language pathologists of ontario", "caslpo")), ("CPBAO", ("college of psychologists and behaviour analysts of ontario", "cpbao")), ("CRPO", ("college of registered psychotherapists of ontario", "crpo")),
    ("OCSWSSW", ("ontario college of social workers and social service workers", "ocswssw")), ("CECE", ("college of early childhood educators", "cece")), ("CDO", ("college of dietitians of ontario", "cdo")), ("OACETT", ("oacett",)), ("OPPI", ("oppi",)),
    ("Law Society of Ontario", ("law society", "law society of ontario")), ("CPA Ontario", ("cpa ontario", "chartered professional accountants of ontario", "chartered professional accountants ontario")), ("CIPHI", ("canadian institute of public health inspectors", "ciphi")),
    ("CSMLS", ("csmls",)), ("HSCPOA", ("hscpoa",)), ("MMAH", ("ministry of municipal affairs", "mmah")),
)
DRIVER = tuple(f"{who} {what}" for who in ("driver", "drivers", "driver s") for what in ("licence", "license", "permit"))
TERMS = ("licence", "license", "licensed", "registration", "registered", "member", "membership", "designation", "certificate of qualification", "p.eng", "p eng", "peng")
CUES = ("must", "valid", "current", "required", "possess", "possession", "hold", "maintain", "essential", "mandatory", "standing")
OTHER = ("software licence", "software license", "application licence", "product licence", "product license", "patent license", "license information", "licence information", "student", "license number", "licence number")
OBTAIN = ("ability to obtain", "able to obtain", "willing to obtain", "willingness to obtain", "obtain and maintain")
EQUIVALENT = ("or equivalent", "or provincial equivalent", "or other provincial equivalent")
ELIGIBLE = ("eligible", "eligibility")
STEMS = stems(TERMS, DRIVER, ("endorsement",))  # what a line with a label mentions
SEPARATOR = r"[()\[\]]|;\s*|\x01|,?\s+and must (?:be able to|have the ability to) (?:obtain )?"
SENTENCE = r"\.\s+([A-Z])"  # before the separator is looked for, such an end gets a mark of its own
CLASS_FORMS = (r"(?i)\bclass ?[\"'“”‘’]?([a-z0-9]{1,3})\b", r"(?i)\b([b-z0-9][a-z0-9]{0,2}|a[a-z0-9]{1,2})[- ]class\b", r"(?i)\b([bcdefg][12]?|dz|az|cz|bz|[1-6]) driver")


def clauses(text: Column) -> Column:
    """The parts of a line between separators (semicolons, ends of sentences) outside all brackets; a bracket that is never opened counts for
    nothing, one that is never closed holds the rest together."""

    def cuts(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.expr("CAST(array() AS array<struct<start:int,end:int,text:string>>)").alias("cuts"))
        opens, closes = lambda m: m["text"].isin("(", "["), lambda m: m["text"].isin(")", "]")
        step = lambda acc, m: F.struct(
            F.when(opens(m), acc["depth"] + 1).when(closes(m), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"]).alias("depth"),
            F.when(~opens(m) & ~closes(m) & (acc["depth"] == 0), F.concat(acc["cuts"], F.array(m))).otherwise(acc["cuts"]).alias("cuts"),
        )
        return F.aggregate(found, start, step, lambda acc: acc["cuts"])

    def parts(line: Column, at: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(at, lambda m: m["end"]))
        ends = F.concat(F.transform(at, lambda m: m["start"]), F.array(F.length(line)))
        return F.filter(F.zip_with(begins, ends, lambda a, z: F.trim(F.replace(F.substring(line, a + 1, z - a), F.lit("\x01"), F.lit(" ")))), lambda p: p != "")

    return let(F.regexp_replace(text, SENTENCE, ".\x01$1"), lambda line: let(cuts(matches(line, SEPARATOR)), lambda at: parts(line, at)))


def _first(words: Column, names) -> Column:
    return F.coalesce(*(F.when(has_phrase(words, phrases), name) for name, phrases in names), F.lit(None).cast("string"))


def _driving(c: Column, words: Column) -> Column:
    """Label of a clause on driving, or null."""
    found = F.array_distinct(F.flatten(F.array(*(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.upper) for p in CLASS_FORMS))))
    z = words.rlike(r" z endorsement | endorsement z ")

    def label(classes: Column) -> Column:
        known = F.filter(classes, lambda x: x.isin(*CLASSES))
        several = F.when(F.size(known) > 1, F.filter(known, lambda x: x != "A")).otherwise(known)
        folded = let(several, lambda s: F.when(z & ~F.exists(s, lambda x: x.endswith("Z")), F.transform(s, lambda x: F.when(x == "D", "DZ").otherwise(x))).otherwise(s))

        def shown(s: Column) -> Column:
            where = F.coalesce(F.concat(_first(words, PROVINCES), F.lit(" ")), F.lit(""))
            kind = F.concat(F.lit("Class "), F.array_join(s, "/"))
            with_end = F.when(z & ~F.exists(s, lambda x: x.endswith("Z")), " with Z endorsement").when(words.rlike(" air ?brakes? "), " with air brake endorsement").otherwise("")
            base = F.when(F.size(s) > 0, F.concat(where, kind, with_end)).when(has_phrase(words, DRIVER), F.when(where == "", "Driver's licence").otherwise(F.concat(where, F.lit("driver's licence"))))
            return F.concat(base, F.when(has_phrase(words, EQUIVALENT), " or equivalent").otherwise(""), F.when(has_phrase(words, OBTAIN), " (able to obtain)").otherwise(""))

        return let(folded, shown)

    return F.when(has_phrase(words, DRIVER) | words.rlike(" licen[cs]e | endorsement "), let(found, label))


def _registered(words: Column) -> Column:
    """Label of a clause on a profession, or null."""

    def label(x: Column) -> Column:
        short = F.regexp_extract(x["role"], r"\(([A-Z-]+)\)$", 1)
        core = F.when(x["role"].isNull(), x["body"]).when(x["body"].isNull(), x["role"]).otherwise(F.concat(F.coalesce(F.nullif(short, F.lit("")), x["role"]), F.lit(" ("), x["body"], F.lit(")")))
        return F.concat(core, F.when(has_phrase(words, ELIGIBLE), " or eligible").otherwise(""))

    return let(F.struct(_first(words, ROLES).alias("role"), _first(words, BODIES).alias("body")), label)


def licence_labels(section: Column, text: Column) -> Column:
    """array<string>: the labels of a requirement line's clauses. Wishes, benefits, licences of software and
    registered students give none; outside a section on requirements a clause needs a word that asks for it."""

    def label(c: Column) -> Column:
        def judged(words: Column) -> Column:
            asks = (section == "required") | has_phrase(words, CUES)
            about = has_phrase(words, (*TERMS, *DRIVER)) | words.rlike(" endorsement ")
            return F.when(asks & about & ~has_phrase(words, (*OPTIONAL, *OTHER)), F.coalesce(_registered(words), _driving(c, words)))

        return let(line_words(c), judged)

    return F.when(section.isin("optional", "benefits"), F.expr("CAST(array() AS array<string>)")).otherwise(F.filter(F.transform(clauses(text), label), lambda x: x.isNotNull()))


def core_words(label: Column) -> Column:
    """The words of a label that tell it from others."""
    return F.array_except(F.filter(F.split(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "), " "), lambda w: w != ""), F.array(*map(F.lit, ("or", "able", "to", "obtain", "equivalent", "eligible", "with", "s"))))


def without_weaker(labels: Column) -> Column:
    """Distinct labels in order, without those whose core words another label has besides more; of drivers' licences
    one without a class goes if another has one."""

    def kept(all_of: Column) -> Column:
        def weaker(x: Column, y: Column) -> Column:
            driver = x["label"].rlike("(?i)driver's licence") & y["label"].rlike(r"\bClass ")
            return driver | ((F.size(F.array_except(x["words"], y["words"])) == 0) & (F.size(y["words"]) > F.size(x["words"])))

        return F.transform(F.filter(all_of, lambda x: ~F.exists(all_of, lambda y: weaker(x, y))), lambda x: x["label"])

    return let(F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x.alias("label"), core_words(x).alias("words"))), kept)
