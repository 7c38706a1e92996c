"""Requirements in the lines of a posting's description: software, languages, vehicle, security, experience,
first aid, typing. ``requirement_lines`` gives the lines; the other functions judge one line each."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions import sections
from harborline.functions.text import collapse, has_phrase, let, mentions, once, stems

# Fixed vocabularies; phrases are those of ``line_words``, where a comma stands for any mark and for the end.
SOFTWARE = (
    ("Microsoft Office", ("microsoft office", "microsoft suite", "ms office", "office 365")),
    ("Microsoft 365", ("microsoft 365", "m365")),
    ("WordPress", ("wordpress", "word press")),
    ("Lotus Notes", ("lotus notes",)),
    ("SIS", ("student information system", "sis")),
    ("Contribute", ("contribute ,",)),
    ("Word", ("microsoft word", "ms word", "word ,", "word and", "word mail merge")),
    ("Excel", ("excel",)),
    ("PowerPoint", ("powerpoint",)),
    ("Outlook", ("outlook",)),
    ("Access", ("microsoft access", "ms access", "access ,", "access and", "access database", "access software", "access application")),
    ("Visio", ("visio",)),
    ("Project", ("microsoft project", "ms project")),
    ("Adobe Acrobat", ("acrobat", "adobe pro")),
    ("Adobe Creative Cloud", ("adobe creative cloud",)),
    ("Photoshop", ("photoshop",)),
    ("Illustrator", ("illustrator",)),
    ("InDesign", ("indesign",)),
    ("Adobe Captivate", ("captivate",)),
    ("AutoCAD", ("autocad",)),
    ("ArcGIS", ("arcgis",)),
    ("QGIS", ("qgis",)),
    ("HEC-RAS", ("hec ras", "hecras")),
    ("SAP", ("sap",)),
    ("Oracle", ("oracle",)),
    ("PeopleSoft", ("peoplesoft",)),
    ("Workday", ("workday",)),
    ("Power BI", ("power bi", "powerbi")),
    ("Tableau", ("tableau",)),
    ("ACL", ("acl",)),
    ("IDEA", ("idea",)),
    ("Brightspace", ("brightspace",)),
    ("Canvas", ("canvas",)),
    ("Windows", ("windows",)),
    ("SharePoint", ("sharepoint",)),
    ("Microsoft Teams", ("microsoft teams",)),
    ("SQL", ("sql",)),
    ("Python", ("python",)),
    ("JavaScript", ("javascript",)),
    ("HTML", ("html",)),
    ("CSS", ("css",)),
    ("TypeScript", ("typescript",)),
    ("Java", ("java",)),
    ("C#", ("c#",)),
    (".NET", (".net", "asp.net")),
)
SOFTWARE_HEADINGS = ("qualif", "skill", "requirement", "education", "training")
OPTIONAL = ("asset", "assets", "preferred", "preferable", "nice to have", "plus", "an advantage", "familiarity")
LANGUAGES = (
    ("English", ("english", "anglais")), ("French", ("french", "français", "francais")), ("Cantonese", ("cantonese",)), ("Mandarin", ("mandarin",)), ("Punjabi", ("punjabi",)),
    ("Arabic", ("arabic",)), ("Ukrainian", ("ukrainian",)), ("Spanish", ("spanish",)), ("German", ("german",)), ("Italian", ("italian",)), ("Portuguese", ("portuguese",)),
)
BILINGUAL = ("bilingual", "bilingualism", "bilingue")
PAIRED = ("both", "official language", "official languages", "english and french", "french and english")
LANGUAGE_LABELS = ("language", "languages", "language requirement", "language requirements", "bilingual", "bilingualism")
LANGUAGE_CUES = ("fluency", "fluent", "required", "requirement", "must", "essential", "mandatory", "proficiency", "proficient")
DRIVERS = tuple(f"{who} {what}" for who in ("driver", "drivers", "driver s") for what in ("licence", "license", "permit", "abstract"))
CAR = ("vehicle", "reliable transportation", "own transportation", "transportation")
OWN_CAR = tuple(f"{how}{a} vehicle" for how in ("access", "access to", "own", "personal", "reliable") for a in ("", " a")) + ("reliable transportation", "vehicle required", "vehicle is required", "vehicle necessary", "vehicle is necessary", "ability to drive", "must drive")
NEEDED = ("required", "needed", "necessary")
NOT_NEEDED = ("not required", "not needed", "not necessary", "unnecessary", "no requirement")
CONDITIONS = tuple(f"{when} {who}{what}" for when in ("for", "if", "where") for who in ("", "position ", "positions ", "role ", "roles ", "job ", "jobs ") for what in ("requiring", "that require", "driving")) + ("when driving is required", "if driving is required")
CAR_CUES = ("valid", "current", "must", "possess", "hold", "maintain", "obtain", "provide", "access to", "own", "personal", "reliable", "required", "mandatory", "license", "licence", "permit", "abstract", "ability to drive")
CAR_OPTIONAL = ("asset", "preferred", "preferable", "nice to have", "desirable", "advantage", "optional")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
EITHER_AED = ("cpr or aed", "cpr and , or aed") + tuple(f"cpr {level}{x} or aed" for level in ("", "level ") for x in "abc")
FIRST_AID_LEVELS = ("Standard", "Emergency", "Intermediate", "Basic", "Advanced")
OTHER_FIRST_AID = ("mental health first aid", "psychological first aid", "st john s", "st johns", "st , john s", "st , johns", "first responder")


def line_words(text: Column) -> Column:
    """Lower-case words between single spaces; marks that end a word are commas, and so is the line's end."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[,;:()/]", " , "), r"\.([^a-z]|$)", " , $1")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(marked, r"[^\p{L}\p{N},#.]+", " ")), F.lit(" , "))


def requirement_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text, section, heading, words) of each line that is neither blank nor a heading; ``heading``
    is the last one before it. Null and empty texts have no lines."""
    rows = sections.lines(df, key, text)
    return rows.filter("NOT is_heading").drop("is_heading").withColumn("words", line_words(F.col("text")))


#: What a line must mention, for ``mentioning``, to name any of these.
FIRST_AID_STEMS = ("aid", "cpr", "aed", "defibrillator")
LANGUAGE_STEMS = stems(*(phrases for _, phrases in LANGUAGES), BILINGUAL)
SOFTWARE_STEMS = stems(*(phrases for _, phrases in SOFTWARE), ("teams",))


def mentioning(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Those of ``requirement_lines`` that mention one of ``parts``; only their words are made, once each."""
    return rows.filter(mentions(F.col("text"), parts)).withColumn("words", once(F.col("words")))


def _named(words: Column, dictionary) -> Column:
    """The names, in the dictionary's order, that have a phrase in ``words``."""
    entries = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*(F.lit(f" {p} ") for p in phrases)).alias("phrases")) for n, phrases in dictionary))
    return F.transform(F.filter(entries, lambda e: F.exists(e["phrases"], lambda p: F.contains(words, p))), lambda e: e["name"])


def on_qualifications(heading: Column) -> Column:
    """Whether a heading is on qualifications; null without a heading."""
    return F.exists(F.array(*map(F.lit, SOFTWARE_HEADINGS)), lambda p: F.contains(heading, p)) & ~F.contains(heading, F.lit("nice to have"))


def software(heading: Column, text: Column, words: Column) -> Column:
    """struct<names, optional> of a line below a heading on qualifications; other lines have no names."""
    wanted = on_qualifications(heading)
    names = F.array_union(_named(words, SOFTWARE), F.when(text.rlike(r"\bTeams\b"), F.array(F.lit("Microsoft Teams"))).otherwise(F.array().cast("array<string>")))
    return F.struct(F.when(F.coalesce(wanted, F.lit(False)), names).otherwise(F.array().cast("array<string>")).alias("names"), has_phrase(words, OPTIONAL).alias("optional"))


def languages(section: Column, words: Column) -> Column:
    """Languages that a line requires; Bilingual alone where it says so or names two as a pair."""
    asks = (section == "required") | F.exists(F.array(*(F.lit(f" {p} , ") for p in LANGUAGE_LABELS)), lambda p: F.startswith(words, p)) | has_phrase(words, LANGUAGE_CUES)
    both = lambda names: has_phrase(words, BILINGUAL) | ((F.size(names) >= 2) & has_phrase(words, PAIRED))
    found = let(_named(words, LANGUAGES), lambda names: F.when(both(names), F.array(F.lit("Bilingual"))).otherwise(names))
    return F.when(asks & (section != "optional") & ~has_phrase(words, OPTIONAL), found).otherwise(F.array().cast("array<string>"))


def vehicle(section: Column, words: Column) -> Column:
    """True where a line requires a vehicle or a driver's licence, False where it says that none is needed, else null.

    Wishes, conditions and a driver's abstract alone require nothing."""
    licence = has_phrase(words, DRIVERS) | words.rlike(r" class [a-z0-9]+ (?:drivers? (?:s )?)?licen[cs]e ")
    term = licence | has_phrase(words, CAR)
    needless = term & (has_phrase(words, NOT_NEEDED) | (has_phrase(words, [f"no {x}" for x in (*DRIVERS, *CAR)]) & has_phrase(words, NEEDED)))
    only_abstract = has_phrase(words, [x for x in DRIVERS if x.endswith("abstract")]) & ~words.rlike(r" (?:licen[cs]e|permit|class [a-z0-9]+) ")
    weak = only_abstract | has_phrase(words, CONDITIONS) | has_phrase(words, CAR_OPTIONAL) | (section == "optional")
    needed = (licence | has_phrase(words, OWN_CAR)) & ((section == "required") | has_phrase(words, CAR_CUES))
    return F.when(needless, False).when(needed & ~weak, True)


def security_label(text: Column) -> Column:
    """What a line labelled ``Security Requirement:`` says: False for none, else True; null without the label."""
    value = F.regexp_extract(text, r"(?i)^\**security requirement:\**\s*(.+)$", 1)
    return F.when(value != "", ~F.lower(value).rlike(r"^(?:none|not required|n/a)\b"))


def experience(text: Column) -> Column:
    """``N years``, ``N+ years`` or ``N–M years`` (or months) that a line on experience asks for; null without."""
    plain = F.concat(F.lit(" "), collapse(F.lower(text)), F.lit(" "))
    for n, name in enumerate(NUMBERS, 1):
        plain = F.regexp_replace(plain, rf"\b{name}\b", str(n))
    plain = F.regexp_replace(plain, r"\b\d+ ?\((\d+)\)", "$1")
    shape = r"(minimum of |minimum |at least |over |more than )?\b(\d+)(\+?)(?: ?(?:-|–|—|to) ?(\d+))? ?(year|month|yr)"

    def label(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, shape, i)
        unit = F.when(part(5) == "month", "month").otherwise("year")
        open_end = (part(1) != "") | (part(3) != "")
        single = F.when(open_end, F.concat(part(2), F.lit("+ "), unit, F.lit("s"))).otherwise(F.concat(part(2), F.lit(" "), unit, F.when(part(2) == "1", "").otherwise("s")))
        return F.when(F.contains(s, F.lit("experience")) & (part(2) != ""), F.when(part(4) != "", F.concat(part(2), F.lit("–"), part(4), F.lit(" "), unit, F.lit("s"))).otherwise(single))

    return let(plain, label)


def typing_speed(text: Column) -> Column:
    """``Typing N w.p.m.`` or ``Typing N–M w.p.m.``; null without a speed."""
    plain = F.regexp_replace(collapse(F.lower(text)), r"w\.? ?p\.? ?m\b\.?|words? per minute", "wpm")
    shape = r"\b(?:typing|keyboarding|types?) (?:speed )?(?:of )?(\d+)(?: ?[-–—] ?(\d+))? ?wpm"
    low, high = F.regexp_extract(plain, shape, 1), F.regexp_extract(plain, shape, 2)
    return F.when(low != "", F.concat(F.lit("Typing "), F.concat_ws("–", low, F.nullif(high, F.lit(""))), F.lit(" w.p.m.")))


def first_aid(words: Column) -> Column:
    """One short label for the level of first aid, CPR and AED that a line requires; null for none, for wishes,
    for programmes of other names and for an ability without a certificate."""
    aid, cpr, aed = has_phrase(words, ("first aid", "firstaid")), has_phrase(words, ("cpr",)), words.rlike(r" aed |defibrillator")
    levels = [has_phrase(words, [f"{x.lower()} first aid"]) for x in FIRST_AID_LEVELS]
    either = (levels[0] & levels[2]) | has_phrase(words, ("standard or intermediate first aid", "intermediate , standard first aid"))
    level = F.when(either, "Standard or Intermediate First Aid")
    for name, hit in zip(FIRST_AID_LEVELS, levels):
        level = level.when(hit, f"{name} First Aid")
    level = level.when(aid, "First Aid")
    grade = F.lit(None).cast("string")
    for letter in ("a", "b", "c"):
        spelt = [f"cpr {letter}", f"cpr level {letter}", f"level {letter} cpr"] + (["class c"] if letter == "c" else [])
        grade = F.when(has_phrase(words, spelt), f"CPR-{letter.upper()}").otherwise(grade)
    grade = F.coalesce(grade, F.when(cpr, "CPR"))
    tail = F.when(aed & has_phrase(words, EITHER_AED), " or AED").when(aed, "/AED").otherwise("")
    other = (aid & has_phrase(words, OTHER_FIRST_AID)) | (has_phrase(words, ("basic cardiac life support", "bls")) & has_phrase(words, ("or",)))
    ability = has_phrase(words, ("ability to provide first aid", "ability to perform first aid", "ability to administer first aid")) & ~cpr & ~F.contains(words, F.lit("certif")) & ~has_phrase(words, [f"{x.lower()} first aid" for x in FIRST_AID_LEVELS])
    label = F.when(~aid & ~cpr & aed, "AED").when(~aid & cpr, F.concat(grade, F.when(aed, "/AED").otherwise(""))).when(grade.isNotNull(), F.concat(level, F.lit(" with "), grade, tail)).when(aed, F.concat(level, F.lit(" with AED"))).otherwise(level)
    return F.when(~(other | ability | has_phrase(words, OPTIONAL)) & (aid | cpr | aed), label)
