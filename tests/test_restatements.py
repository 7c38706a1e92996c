from pyspark.sql import functions as F

from harborline.functions.restatements import without_restatements
from harborline.plans.restatements import BLOCKS

VALUES = "array<struct<field:string,value:string>>"


def cleaned(spark, text, *values, rounds=5):
    df = spark.createDataFrame([(text, [tuple(v) for v in values])], f"text string, known {VALUES}")
    return df.select(without_restatements(F.col("text"), F.col("known"), rounds)).first()[0]


CASES = [
    ("Valid Class G driver's license", [("vehicle", "Class G driver's licence")], None),
    ("A nursing licence", [("vehicle", "Class G driver's licence")], "A nursing licence"),
    ("Three (3) years of related experience", [("experience", "3 years")], None),
    ("5 years of experience", [("experience", "3 years"), ("experience", "5 months")], "5 years of experience"),
    ("Strong Excel, Word and planning skills", [("software", "Excel"), ("software", "Word")], "Planning skills"),
    ("Bilingual in English and French", [("language", "English"), ("language", "French")], None),
    ("Knowledge of French is an asset", [("language", "French")], "Knowledge of French is an asset"),
    ("Languages other than English", [("language", "English")], "Languages other than English"),
    ("Degree in nursing; first aid certification", [("certificate", "First Aid")], "Degree in nursing"),
    ("Completion of a university degree in Nursing.", [("education", "Degree in nursing")], None),
    ("Satisfactory criminal record check", [("security", "Criminal record check")], None),
    ("Excel", [], "Excel"),
    ("Excel", [("unknown", "Excel")], "Excel"),
    ("and", [("software", "Excel")], "and"),
]


def test_bullets(spark):
    rows = [(i, f"## Requirements\n- {bullet}\n- Punctual", values) for i, (bullet, values, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"n int, text string, known {VALUES}")
    got = {r[0]: r[1] for r in df.select("n", without_restatements(F.col("text"), F.col("known"))).collect()}
    for i, (bullet, _, wanted) in enumerate(CASES):
        assert got[i] == "## Requirements\n" + (f"- {wanted}\n" if wanted else "") + "- Punctual", bullet


def test_only_sections_on_requirements_and_only_bullets(spark):
    text = "Excel\n## Duties\n- Excel\n## Skills\nExcel\n1) Excel\n2) Word"
    assert cleaned(spark, text, ("software", "Excel")) == "Excel\n## Duties\n- Excel\n## Skills\nExcel\n2) Word"


def test_passes_follow_until_nothing_changes(spark):
    """The first pass makes a repeated bullet, the second takes it away, the third the heading that it leaves."""
    text = "## Skills\n- Planning skills\n\n## Requirements\n- Excel and planning skills"
    known = ("software", "Excel")
    assert cleaned(spark, text, known, rounds=1).endswith("## Requirements\n- Planning skills")
    assert cleaned(spark, text, known) == "## Skills\n- Planning skills"


def test_cleaned_texts_stay_as_they_are(spark):
    df = spark.createDataFrame([("Intro\n\n" + text, list(values)) for text, values in BLOCKS], f"text string, known {VALUES}")
    once = spark.createDataFrame(df.select(without_restatements(F.col("text"), F.col("known")).alias("text"), "known").collect(), f"text string, known {VALUES}")
    again = once.select("text", without_restatements(F.col("text"), F.col("known")).alias("again")).collect()
    assert all(r["text"] == r["again"] for r in again) and len(again) == len(BLOCKS)


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(None, None), ("", []), ("## Skills\n- a\n- A", None)], f"text string, known {VALUES}")
    assert [r[0] for r in df.select(without_restatements(F.col("text"), F.col("known"))).collect()] == ["", "", "## Skills\n- a"]
