import pytest
from pyspark.sql import functions as F

from harborline.functions import requirements as R


def found(spark, text):
    """The requirement lines of one description."""
    return R.requirement_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("## Qualifications\n- Valid driver's licence", True),
        ("## Requirements\n- Access to a reliable vehicle is required", True),
        ("## Nice to Have\n- Access to a vehicle", None),
        ("## Qualifications\n- Licence for positions requiring driving", None),
        ("Successful candidates may be required to provide a driver's abstract check.", None),
        ("Travel between sites may be required.", None),
        ("A driver license is an asset but not required.", False),
        ("", None),
        (None, None),
    ],
)
def test_vehicle(spark, text, wanted):
    assert found(spark, text).agg(F.bool_or(R.vehicle(F.col("section"), F.col("words")))).first()[0] is wanted


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("Standard First Aid with CPR-C and AED", "Standard First Aid with CPR-C/AED"),
        ("CPR level B", "CPR-B"),
        ("Emergency First Aid, CPR or AED", "Emergency First Aid with CPR or AED"),
        ("Intermediate/Standard first aid", "Standard or Intermediate First Aid"),
        ("AED", "AED"),
        ("First-Aid", "First Aid"),
        ("Mental health first aid", None),
        ("Ability to provide first aid", None),
        ("First aid is an asset", None),
        ("Clerk", None),
        (None, None),
    ],
)
def test_first_aid(spark, line, wanted):
    assert spark.createDataFrame([(line,)], "x string").select(R.first_aid(R.line_words(F.col("x")))).first()[0] == wanted


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("Three (3) years of experience", "3 years"),
        ("Minimum of one year experience", "1+ years"),
        ("1 year of experience", "1 year"),
        ("5+ yrs related experience", "5+ years"),
        ("2 to 4 years' experience", "2–4 years"),
        ("18 months experience", "18 months"),
        ("3 years of study", None),
        ("Several years of experience", None),
        (None, None),
    ],
)
def test_experience(spark, line, wanted):
    assert spark.createDataFrame([(line,)], "x string").select(R.experience(F.col("x"))).first()[0] == wanted


def test_typing_and_security(spark):
    rows = [("Typing 40 w.p.m.",), ("typing speed of 50 - 60 words per minute",), ("Security Requirement: Secret",), ("**Security Requirement:** Not required",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(R.typing_speed(F.col("x")), R.security_label(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("Typing 40 w.p.m.", None), ("Typing 50–60 w.p.m.", None), (None, True), (None, False), (None, None)]


def test_software_stands_below_its_headings(spark):
    text = "## Qualifications\n- Word, C# and .NET.\n- Teams\n- Excel is an asset\n## Nice to Have\n- Tableau\n## About\n- Java\n- word of mouth"
    rows = found(spark, text).select("line", R.software(F.col("heading"), F.col("text"), F.col("words")).alias("s")).orderBy("line").collect()
    assert [(r["s"]["names"], r["s"]["optional"]) for r in rows] == [(["Word", "C#", ".NET"], False), (["Microsoft Teams"], False), (["Excel"], True), ([], False), ([], False), ([], False)]


def test_languages(spark):
    text = "## Qualifications\n- German, Italian\n- English and French\n- Spanish preferred\n## About\n- Language: Arabic\n- Arabic is spoken here"
    rows = found(spark, text).select("line", R.languages(F.col("section"), F.col("words")).alias("x")).orderBy("line").collect()
    assert [r["x"] for r in rows] == [["German", "Italian"], ["Bilingual"], [], ["Arabic"], []]
