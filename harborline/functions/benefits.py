"""Benefits and certifications as short labels: lists of values are judged against tables of phrases, lines of a
description against names."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.requirements import FIRST_AID_STEMS, OPTIONAL, first_aid, line_words
from harborline.functions.text import collapse, has_phrase, let, plain_words, stems

_times = lambda heads, tails: tuple(" ".join(x for x in (a, b) if x) for a in heads for b in tails)
# Labels and the whole phrases that stand for them (words only), some with two labels; phrases that name no
# benefit; words that make a detail; pension plans by name.
LABELS = (
    (("Wellness", "Employee Assistance Program"), ("wellness and employee assistance program", "wellness and employee assistance programs")),
    (("Employee Assistance Program", "Wellness"), ("employee assistance and wellness benefit program", "employee assistance and wellness benefit programs")),
    (("Health Insurance", "Dental Insurance"), ("health dental", "health and dental", "health dental benefit", "health and dental benefit", "health dental benefits", "health and dental benefits")),
    (("Vacation",), _times(("", "accrued", "annual", "annual paid", "paid"), ("vacation", "vacation pay", "vacation credit", "annual leave", "paid leave", "paid time off", "pto", "leave policy"))),
    (("Performance Bonuses",), _times(("", "performance", "annual individual", "annual individual performance"), ("bonus", "bonuses", "incentive", "incentives", "bonus plan", "incentive plan")) + ("performance based incentive plan", "performance pay", "variable pay")),
    (("Group Insurance",), ("group insurance", "group insurance coverage", "group insurance plan")),
    (("Health Insurance",), ("health", "healthcare", "health insurance", "extended health", "extended health care", "extended health and benefit plan", "medical", "medical insurance")),
    (("Health Spending Account",), ("health care spending account", "healthcare spending account", "health spending account")), (("Dental Insurance",), ("dental", "dental insurance", "dental care")), (("Vision Care",), ("vision", "vision care", "extended vision care")),
    (("Life Insurance",), _times(("", "group", "basic", "group basic"), ("life", "life insurance"))), (("AD&D Insurance",), ("accidental death and dismemberment",)),
    (("Disability Insurance",), _times(("", "short term", "long term", "academic long term"), ("disability", "disability insurance"))),
    (("Employee Assistance Program",), ("efap", "eap") + _times(("employee", "employee family", "employee and family", "family"), ("assistance program", "assistance programs")) + _times(("employee", "employee family and", "family"), ("assistance plan",))),
    (("Fitness Membership",), _times(("fitness", "gym", "fitness centre", "fitness center", "fitness centre access", "fitness center access"), ("", "membership", "access")) + _times(("discounted", "complimentary"), ("fitness membership", "fitness memberships", "fitness centre membership", "fitness centre memberships")) + ("fitness membership discount", "fitness membership discounts")),
    (("Wellness",), ("wellness centre access", "wellness center access", "corporate wellness program")), (("Travel Benefits",), ("out of province out of country coverage", "out of country care", "travel insurance", "emergency travel assistance")),
    (("Tuition Waiver",), _times(("tuition waiver", "tuition remission"), ("", "program"))), (("Tuition Assistance",), ("tuition aid", "tuition reimbursement") + _times(("tuition assistance", "tuition subsidy", "tuition subsidies"), ("", "program"))),
    (("Parental Leave Top Up",), ("parental leave top up",)), (("OMERS",), ("omers", "omers pension", "omers pension plan")), (("Pension",), ("pension", "pension plan", "retirement", "retirement plan", "retirement plans", "defined benefit pension plan", "defined contribution pension plan")),
    (("Perkopolis",), ("perkopolis perk", "perkopolis perks")), (("Transit Pass",), _times(("", "discounted"), ("transit pass", "transit passes", "transit pass discount", "transit passes discounts"))), (("Employee Bus Pass",), ("bus pass",)),
)
NO_BENEFIT = (
    "advancement opportunity", "advancement opportunities", "benefit", "benefits", "benefit package", "benefits package", "competitive benefits", "competitive benefits package", "competitive benefits program", "competitive benefits programs", "comprehensive benefit package",
    "comprehensive benefits package", "continuous learning", "education", "employee benefits and development", "employee learning and development", "inclusive culture", "inclusive workplace culture", "leadership development", "learning and development", "learning development", "learning and development opportunities",
    "learning and development program", "learning and development programs", "online learning", "positive workplace culture", "positive workplace culture and work life balance", "professional learning and development", "recognition program", "recognition programs", "remote work", "remote work program", "remote work programs",
    "staff development", "work life balance", "access to bcit flexible learning course", "access to bcit flexible learning courses",
) + _times(("career advancement", "career development", "career growth"), ("", "opportunity", "opportunities")) + _times(("flex", "flexible"), ("workplace", "workplace option", "workplace options", "work program", "work arrangement", "work arrangements", "work option", "work options")) + _times(("professional development", "professional learning"), ("", "day", "days", "fund", "funds", "funding"))
NO_BENEFIT_WORDS = ("training", "trainings", "mentorship")
DETAIL_PHRASES = ("in lieu", "depending on", "up to")
PENSIONS = (("OMERS", ("omers",)), ("HOOPP", ("hoopp",)), ("CAAT Pension Plan", ("caat plan", "caat pension plan")), ("Municipal Pension Plan", ("municipal pension plan",)), ("Public Service Pension Plan", ("public service pension plan",)))
CERTIFICATES = (
    ("WHMIS", ("whmis", "whimis") + _times(("whmis", "whimis"), ("training", "certification", "certificate"))), ("Smart Serve", ("smart serve", "smart serve certification")), ("Food Handler", _times(("food handler", "food handlers"), ("", "certification")) + ("food handling certification",)),
    ("HIGH FIVE Certificate", ("high five certificate",)), ("NCCP Level 2 (theory and practical)", ("certified in nccp level 2 theory and practical",)),
)
CERTIFICATES_WITHIN = (("Food Handler", ("food safety certification course food handler training", "food safety certification course food handlers training")), ("Worker Health and Safety Awareness training", ("worker health and safety awareness",)), ("Supervisor Health and Safety Awareness training", ("supervisor health and safety awareness",)))
NAMED_CERTIFICATES = (("WHMIS", ("whmis",)), ("Smart Serve", ("smart serve",)), ("Food Handler", ("food handler", "food handlers")), ("Nonviolent Crisis Intervention", ("nonviolent crisis intervention",)))
WISHED = ("preferred", "preferable", "preference", "nice to have", "desirable", "optional") + _times(("would be", "would", "is", "are"), ("considered an asset", "considered a asset", "be considered an asset"))
NO_CERTIFICATE = _times(("criminal record", "criminal records", "vulnerable sector", "vulnerable sector police", "police", "background"), ("check", "clearance")) + (
    "security clearance", "safety footwear", "green patch", "mandatory legislated training", "environmental safety and any other training required by corporate policy", "occupational health and safety workshops", "ability to obtain a city of brampton cob permit",
    "ability to complete re qualification training and testing", "anti rabies vaccination", "rabies titer", "proof of immunity for hepatitis b",
)
NO_CERTIFICATE_STARTS = ("active member", "current membership in professional governing body")


def _table(entries) -> Column:
    """A map from whole phrases to arrays of labels."""
    pairs = {p: labels if isinstance(labels, tuple) else (labels,) for labels, phrases in reversed(entries) for p in phrases}
    return F.create_map(*(x for p, labels in pairs.items() for x in (F.lit(p), F.array(*map(F.lit, labels)))))


def _cased(c: Column) -> Column:
    """Each word with a capital in front and the rest in lower case, words in capitals and digits as they are."""
    def word(w: Column) -> Column:
        keeps = F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "").rlike("^[A-Z0-9]{2,}$")
        return F.when(keeps, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[^ /&]+|[ /&]"), F.lit(0)), word), "")


def benefit_labels(value: Column) -> Column:
    """array<string> of a value: two labels for compounds, none for what is no benefit. Values with a number or a
    condition keep their words, and so do unknown ones."""

    def labels(v: Column) -> Column:
        def named(words: Column) -> Column:
            key = F.trim(words)
            dropped = (key == "") | key.isin(*NO_BENEFIT) | has_phrase(words, NO_BENEFIT_WORDS)
            detail = v.rlike(r"\d") | has_phrase(words, DETAIL_PHRASES)
            known = F.when(~detail, F.try_element_at(_table(LABELS), key))
            return F.when(dropped, F.array().cast("array<string>")).otherwise(F.coalesce(known, F.array(_cased(v))))

        return let(plain_words(v), named)

    return let(F.regexp_replace(collapse(F.coalesce(value, F.lit(""))), r"[ .;,:]+$", ""), labels)


def benefits(values: Column) -> Column:
    """The labels of all values in order, each once; a plan with a name makes a bare ``Pension`` go."""
    names = [n for n, _ in PENSIONS]
    found = F.array_distinct(F.flatten(F.transform(values, benefit_labels)))
    return let(found, lambda all_of: F.filter(all_of, lambda x: (x != "Pension") | ~F.exists(all_of, lambda y: y.isin(*names))))


#: What a line that names a plan or a certificate mentions.
PENSION_STEMS = stems(*(phrases for _, phrases in PENSIONS))
CERTIFICATE_STEMS = (*FIRST_AID_STEMS, *stems(*(phrases for _, phrases in NAMED_CERTIFICATES)))


def named_benefits(section: Column, text: Column) -> Column:
    """The pension plans that a line in a section on benefits names."""
    def names(words: Column) -> Column:
        return F.filter(F.array(*(F.when(has_phrase(words, phrases), n) for n, phrases in PENSIONS)), lambda x: x.isNotNull())

    return F.when(section == "benefits", let(plain_words(text), names)).otherwise(F.array().cast("array<string>"))


def certificate_label(value: Column) -> Column:
    """A certificate's short label; a value that is none of the known ones stays, null for wishes and for what is no certificate."""

    def label(v: Column) -> Column:
        def judged(words: Column) -> Column:
            starts = reduce(lambda a, b: a | b, (F.startswith(words, F.lit(f" {p} ")) for p in NO_CERTIFICATE_STARTS))
            known = F.coalesce(first_aid(line_words(v)), F.get(F.try_element_at(_table(CERTIFICATES), F.trim(words)), F.lit(0)), *(F.when(has_phrase(words, phrases), n) for n, phrases in CERTIFICATES_WITHIN), v)
            return F.when((v != "") & ~starts & ~has_phrase(words, (*WISHED, *NO_CERTIFICATE)) & ~F.lower(v).rlike(r"\( ?asset ?\)"), known)

        return let(plain_words(v), judged)

    return let(F.regexp_replace(collapse(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[“”]", '"'), "[‘’]", "'")), r"\.$", ""), label)


def certificates(values: Column) -> Column:
    """The labels of all values in order, each once in whatever case."""
    found = F.filter(F.transform(values, certificate_label), lambda x: x.isNotNull())
    return let(found, lambda all_of: let(F.transform(all_of, F.lower), lambda keys: F.filter(all_of, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)))


def line_certificates(section: Column, text: Column) -> Column:
    """Labels of first aid and of named certificates that a line requires."""
    def found(words: Column) -> Column:
        names = F.array(first_aid(words), *(F.when(has_phrase(words, phrases), n) for n, phrases in NAMED_CERTIFICATES))
        return F.filter(names, lambda x: x.isNotNull())

    wanted = ~section.isin("optional", "benefits") & ~has_phrase(line_words(text), OPTIONAL)
    return F.when(wanted, let(line_words(text), found)).otherwise(F.array().cast("array<string>"))


def one_first_aid(labels: Column) -> Column:
    """Distinct labels in order, at the end the longest of those on first aid (the first of equally long ones)."""
    about = lambda x: F.lower(x).rlike(r"\bfirst aid\b|\bcpr\b")

    def split(all_of: Column) -> Column:
        longest = F.array_sort(F.transform(F.filter(all_of, about), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
        return F.concat(F.filter(all_of, lambda x: ~about(x)), F.transform(F.slice(longest, 1, 1), lambda s: s["x"]))

    return let(F.array_distinct(labels), split)
