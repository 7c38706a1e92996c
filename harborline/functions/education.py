"""Education that the lines of a description require: labels, and a partial order that tells which of them others imply.

A line's levels are alternatives where it says "or", else all of them count. What suffices for a line is the set of
levels at or above them, kept as bits: one line implies another if whatever suffices for it suffices for the other.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.requirements import OPTIONAL, line_words
from harborline.functions.text import any_of, branching, collapse, has_phrase, let, mentions, stems

# Levels, what each of them includes directly, and phrases (see ``line_words``) that name them.
LEVELS = (
    ("some_high_school", (), ("partial high school", "partial secondary school", "years of high school", "years of secondary school", "year of high school", "year of secondary school")),
    ("high_school", ("some_high_school",), ("high school", "secondary school", "grade 12", "ossd", "o.s.s.d", "ged", "g.e.d", "caec", "c.a.e.c")),
    ("post_secondary", ("high_school",), ("post secondary education", "post secondary program", "post secondary diploma", "post secondary degree", "postsecondary education")),
    ("student", ("high_school",), ("currently enrolled", "current enrolment", "current enrollment", "currently enrolment", "student status", "student enrolment", "student enrollment", "registration in a co op program", "registration in co op program")),
    ("diploma", ("post_secondary",), ("diploma", "associate degree", "associate s degree", "associates degree")),
    ("degree", ("post_secondary",), ("degree in", "degree from", "degree required", "degree is required", "degree or", "degree program", "diploma or degree", "university degree", "degree ,")),
    ("bachelor", ("degree",), ("bachelor", "bachelors", "bachelor s", "baccalaureate", "undergraduate degree", "bscn", "bsn", "ba", "b.a")),
    ("law", ("degree",), ("bachelor of law", "bachelor of laws", "juris doctor", "ll.b", "llb", "j.d", "jd")),
    ("master", ("bachelor",), ("master", "masters", "master s", "graduate degree", "mba", "ma", "m.a")),
    ("doctorate", ("master",), ("phd", "ph.d", "doctorate", "doctoral", "doctor of")),
)
VERIFICATION = tuple(f"{a} of {b}" for a in ("verification", "proof") for b in ("degree", "education", "educational", "diploma", "transcript", "equivalency", "equivalencies"))
OTHER = ("master electrician", "leading", "institution offering", "supports students", "support students", "position is", "campus events")
WISHES = (*OPTIONAL, "preference", "desirable", "advantage", "optional", "would be great")
KNOWLEDGE = ("familiarity", "knowledge", "experience", "proficiency", "understanding", "working knowledge", "demonstrated", "strong", "excellent")
FORMAL = ("bachelor", "bachelors", "bachelor s", "master", "masters", "master s", "phd", "ph.d", "doctorate", "doctoral", "diploma", "degree", "bscn", "bsn", "undergraduate", "graduate", "enrolled", "enrolment", "enrollment", "completion of")
STARTS = ("a", "an", "minimum", "completion", "completed", "successful", "degree", "diploma", "post secondary", "undergraduate", "graduate", "secondary school", "your educational", "candidate must", "candidates must", "must", "currently enrolled", "we are seeking", "graduation")
CUES = ("required", "minimum", "must", "completion", "completed", "successful", "degree in", "diploma in", "equivalent", "eligible", "graduate", "undergraduate", "post secondary program", "post secondary institution", "education in", "a post secondary education", "secondary school")
YEARS = ("one", "two", "three", "four")
SCHOOL_DIPLOMA = r"(?i)\b(high|secondary) school (?:\(high school\) )?(?:graduation )?diploma\b"  # no diploma of a college
SCHOOL_YEARS = r"(?i)\b(one|two|three|four|[1-4]) years? of (?:high|secondary) school"
PLUS_PROGRAM = r"(?i)\bplus\b.*\b(?:program|diploma|certificate)\b"
FIELD = r" in ([A-Za-z0-9].*)$"
# Words around a level that say nothing. Each is a phrase; a space stands for any white space.
PREFACE = ("your application must clearly explain how you meet the following",)
WISHED = ("asset", "assets", "preferred", "preferable", "advantage", "desirable")
REST = ("**candidates invited", "**candidate invited", "learn more about", "applied / assessed", "applied/assessed", "competency:", "competencies:", "competencies :")  # from here on nothing is on education
SENTENCES = ("demonstrated", "a demonstrated", "ability", "an ability", "the ability", "candidate has")  # what a sentence on something else begins with
JUDGEMENTS = ("acceptable", "approved", "equivalent", "employer-approved", "employer approved")
OBTAINED = ("(already obtained or obtained before appointment)", "from a recognized post-secondary institution", "from an accredited post-secondary institution", "from a recognized post secondary institution", "from an accredited post secondary institution")
EQUALS = ("or higher", "or equivalent", "or the equivalent", "or employer-approved alternative", "or employer-approved alternatives", "or employer approved alternatives")
OPENINGS = ("successful completion of", "completion of", "completed", "must have", "must hold", "must possess", "candidate must", "candidates must", "candidates must have", "minimum", "minimum of", "minimum:", "graduation with", "graduation from an accredited community college with", "obtained", "up to", "a", "an", "the", "or")
REGISTERED = ("registration or", "registration with", "registration in", "registration as", "registration through")
HELD = ("valid", "current", "must have", "must hold", "must possess", "registered as", "registered with")
PAPERS = ("licence", "license", "p.eng", "p. eng", "professional engineer", "registration", "certificate of qualification")
SPELLINGS = (  # what a label begins with, in one spelling
    ("Bachelor's degree", ("bachelor degree", "bachelors degree", "bachelor's degree", "bachelor’s degree", "bachelors' degree", "undergraduate degree"), ("bachelor", "bachelors", "bachelor's", "bachelor’s")),
    ("Master's degree", ("master degree", "masters degree", "master's degree", "master’s degree", "masters' degree"), ("master", "masters", "master's", "master’s")),
    ("PhD", ("ph.d. degree", "ph.d degree", "phd degree", "ph.d.", "ph.d", "phd"), ()), ("College diploma", ("advanced college diploma", "college diploma"), ()),
)


def _spelt() -> tuple:
    """A level in front in its one spelling; a bare name counts only before a field and at the end."""
    full = tuple((rf"^{any_of(names)}(\s.*|[^a-zA-Z].*|)$", rf"{label}\1") for label, names, _ in SPELLINGS)
    return full + tuple((rf"^{any_of(bare)}(\s+in\s.*|)$", rf"{label}\1") for label, _, bare in SPELLINGS if bare)


_CODE = r"[A-Z]{2,}(?:-[A-Z0-9]+)+"
_LABELLED = rf"(?:(?i:education|amendment to education|a?ed ?\d+|stream ?\d+[^*:]{{0,60}}|[a-z]{{1,6}}-\d\d(?: ?/ ?[a-z]{{1,6}}-\d\d)? only)|{_CODE}|[A-Z][A-Za-z /.-]{{1,40}} \({_CODE}\))"
ASIDES = (  # labels in front, asides of wishes and the rest, before a line is judged
    (rf"^{any_of(PREFACE)}\s*", ""),
    (rf"^[*\s:–—-]*(?:{_LABELLED}\*{{0,2}} ?[.:–—-][*\s.:–—-]*)+", ""),
    (rf"\([^()]{{0,200}}\b{any_of(WISHED)}\b[^()]{{0,200}}\)", ""),
    (rf" ?{any_of(REST)}.*$", ""),
    (rf"\.\s+{any_of(SENTENCES)}\b.*$", ""),
)
STEPS = (
    (rf"[ ,;.(–—-]{{0,4}}\b(?i:(?:or |and )?(?:an? |the )?(?:{any_of(JUDGEMENTS)} )*combinations? (?:of|considered)\b).*$", ""),
    (rf" ?{any_of(OBTAINED)}", ""),
    (r"(?i) with acceptable specialization in ", " in "),
    (r"(?i),? (?:with|and|plus) (?:[a-z(),0-9+]+ ){0,6}(?:years?|yrs?)\b.{0,80}\bexperience\b.*$", ""),
    (rf",? (?:and )?{any_of(HELD)} .{{0,120}}{any_of(PAPERS)}.*$", ""),
    (rf",? (?:and )?{any_of(REGISTERED)} .*$", ""),
    (rf",? {any_of(EQUALS)}(?: ?\([^()]*\))?[.;, ]*$", ""),
    (rf"^(?:{any_of(OPENINGS)}\s+)+", ""),
    *_spelt(),
    (r"^College diploma \(\d+ years?\)", "College diploma"),
    (r"^degree\b", "Degree"),
    (r"(?:[;,.:*( –—-]| (?i:with|and|or)\b[;,.]?)+$", ""),
)

#: What a line must mention, for ``mentions``, so that a step's pattern can match; patterns without an entry cost little.
STEMS = {
    ASIDES[3][0]: stems(REST), STEPS[0][0]: ("combination",), STEPS[1][0]: stems(OBTAINED), STEPS[2][0]: ("specialization",), STEPS[3][0]: ("experience",), STEPS[4][0]: stems(PAPERS),
    STEPS[5][0]: stems(REGISTERED), STEPS[6][0]: stems(EQUALS),
}


def suffices() -> dict[str, int]:
    """For each level the bits of the levels that suffice for it: its own and those that include it, however indirectly."""
    names, includes = [n for n, _, _ in LEVELS], {n: below for n, below, _ in LEVELS}

    def reaches(a: str, b: str) -> bool:
        return a == b or any(reaches(x, b) for x in includes[a])

    return {n: sum(1 << i for i, m in enumerate(names) if reaches(m, n)) for n in names}


def _changed(c: Column, steps) -> Column:
    def step(x: Column, s) -> Column:
        replaced = lambda v: F.regexp_replace(v, s[0], s[1].replace("\\", "$"))
        return let(x, lambda v: F.when(mentions(v, STEMS[s[0]]), replaced(v)).otherwise(v)) if s[0] in STEMS else replaced(x)

    return collapse(reduce(step, steps, c))


def _bits(words: Column) -> Column:
    up = suffices()
    hits = [(has_phrase(words, phrases), up[name]) for name, _, phrases in LEVELS]
    either = reduce(lambda a, b: a.bitwiseOR(b), (F.when(h, bits).otherwise(0) for h, bits in hits))
    every = reduce(lambda a, b: a.bitwiseAND(b), (F.when(h, bits).otherwise(-1) for h, bits in hits))
    return F.when(either == 0, 0).when(words.contains(" or ") | words.contains(" , "), either).otherwise(every)


def _school(text: Column, words: Column) -> Column:
    """Label of a line that names a high school."""
    def lasting(n: Column) -> Column:
        number = reduce(lambda c, i: c.when(n == YEARS[i], str(i + 1)), range(len(YEARS)), F.when(n == "", None)).otherwise(n)
        return let(number, lambda k: F.concat(k, F.lit(" year"), F.when(k == "1", "").otherwise("s"), F.lit(" of high school")))

    field = F.regexp_extract(F.regexp_replace(text, r"(?i),? or equivalent[.;, ]*$", ""), FIELD, 1)
    plus = let(field, lambda f: F.when(f != "", F.concat(F.lit("High school diploma plus program in "), F.regexp_replace(f, "[.;, ]+$", ""))).otherwise("High school diploma plus related program"))
    years = let(F.lower(F.regexp_extract(text, SCHOOL_YEARS, 1)), lasting)
    partial = F.when(has_phrase(words, ("partial high school", "partial secondary school")), "Partial high school")
    return F.when(text.rlike(PLUS_PROGRAM), plus).otherwise(F.coalesce(years, partial, F.when(has_phrase(words, ("personal support worker",)), "High school diploma and Personal Support Worker certificate"), F.lit("High school diploma")))


def education_label(text: Column) -> Column:
    """struct<label, bits, field> of a stored value or of a line that requires education; the label is empty where
    nothing is left. Labels are their own labels."""
    return let(_changed(F.coalesce(text, F.lit("")), ASIDES), _labelled)


def _labelled(text: Column) -> Column:
    """``education_label`` of a text without its asides."""

    def prose(t: Column) -> Column:
        return let(_changed(t, STEPS), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))

    def short(s: Column) -> Column:
        first = F.trim(F.get(F.split(s, "[.;]"), F.lit(0)))
        return F.when((F.length(s) > 160) & (F.length(first) >= 12), first).otherwise(s)

    def label(words: Column) -> Column:
        school = has_phrase(words, LEVELS[0][2] + LEVELS[1][2])
        proof = has_phrase(words, VERIFICATION) | has_phrase(words, ("education verification",))
        text_of = F.when(proof, "Education verification").when(school, _school(text, words)).otherwise(let(prose(text), short))
        bits = F.when(proof, 0).when(school & words.contains(" year"), suffices()["some_high_school"]).when(has_phrase(words, LEVELS[0][2]), suffices()["some_high_school"]).when(school, suffices()["high_school"]).otherwise(_bits(words))
        return let(text_of, lambda s: F.struct(s.alias("label"), bits.alias("bits"), F.lower(F.regexp_extract(s, FIELD, 1)).alias("field")))

    return let(line_words(F.regexp_replace(text, SCHOOL_DIPLOMA, "$1 school")), label)


def education(section: Column, text: Column) -> Column:
    """struct<label, bits, field> of a line that requires education, else null.

    Wishes, benefits, trades and words on knowledge require none; outside a section on requirements a line must begin
    like one and ask for it, and has at most 300 characters."""

    def judged(t: Column) -> Column:
        def required(words: Column) -> Column:
            begins = lambda phrases: F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.startswith(words, p))
            school = has_phrase(words, LEVELS[0][2] + LEVELS[1][2])
            known = F.exists(F.array(*(F.lit(f" {p} ") for _, _, phrases in LEVELS for p in phrases)), lambda p: F.contains(words, p))
            asks = (section == "required") | ((F.length(t) <= 300) & (school | (begins(STARTS) & (has_phrase(words, CUES) | has_phrase(words, LEVELS[3][2])))))
            knowledge = begins(KNOWLEDGE) & ~has_phrase(words, FORMAL) & ~school
            return has_phrase(words, VERIFICATION) | (known & asks & ~knowledge & ~has_phrase(words, (*WISHES, *OTHER)))

        return let(line_words(t), required)

    spelt = sorted({p.split(" ")[0] for _, _, phrases in LEVELS for p in phrases} | {p.split(" ")[0] for p in VERIFICATION})
    possible = F.lower(text).rlike(f"(?<![a-z0-9]){branching(spelt)}(?![a-z0-9])")  # most lines end here
    return F.when(~section.isin("optional", "benefits") & possible, let(_changed(text, ASIDES), lambda t: F.when(judged(t), _labelled(t))))


def without_implied(found: Column) -> Column:
    """Labels of array<struct<label, bits, field>> in order, each once, without those that another one implies: what
    suffices for that one suffices here, and no field is named here or the same one there."""

    def kept(all_of: Column) -> Column:
        def implied(x: Column, y: Column) -> Column:
            inside = (y["bits"] != 0) & (y["bits"].bitwiseAND(F.bitwise_not(x["bits"])) == 0)
            return inside & ((y["bits"] != x["bits"]) | ((x["field"] == "") & (y["field"] != ""))) & ((x["field"] == "") | (x["field"] == y["field"]))

        return F.array_distinct(F.transform(F.filter(all_of, lambda x: ~F.exists(all_of, lambda y: implied(x, y))), lambda x: x["label"]))

    return let(F.array_distinct(F.filter(found, lambda x: x["label"] != "")), kept)


# What a reader's filter on a level looks for in the lower-case text of a stored value.
LEVEL_WORDS = (
    ("high_school", "high school|secondary school|grade *12|high-school"), ("diploma", "diploma|certificate|college (degree|credential)"), ("bachelors", "bachelor|baccalaureate|undergraduate degree"),
    ("masters", "master|graduate degree"), ("doctorate", "doctorate|doctoral|ph\\.?d|d\\.?phil"), ("student", "currently enrolled|student status|enrolled in|post-secondary student"),
)


def education_text(value: Column) -> Column:
    """Lower-case text of a stored value: the elements of a JSON array or the values of a JSON object between single
    spaces, anything else as it stands; empty for null. Elements that aren't text count as written in JSON."""

    def flat(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        elements = F.when(kind.startswith("ARRAY"), v.cast("array<string>")).when(kind.startswith("OBJECT"), F.map_values(v.cast("map<string,string>")))
        return F.coalesce(F.array_join(elements, " ", "null"), value)

    return F.lower(F.coalesce(let(F.try_parse_json(value), flat), value, F.lit("")))


def matches_level(value: Column, level: str) -> Column:
    return education_text(value).rlike(dict(LEVEL_WORDS)[level])


def matches_field(value: Column, field: str) -> Column:
    """Whether the value holds ``field`` in either case; an empty field holds everywhere."""
    return education_text(value).contains(field.strip().lower())
