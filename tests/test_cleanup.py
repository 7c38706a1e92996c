import pytest
from pyspark.sql import functions as F

from harborline.functions import cleanup as C


def cleaned(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(C.as_markdown(f(C.markdown_sections(F.col("x"))))).first()[0]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("intro\n## A\nx\n### B\n\n#no\n", [("", "intro"), ("A", "x"), ("B", "#no")]),
        ("## A\n## B", [("A", ""), ("B", "")]),
        ("\n \n", []),
        ("", []),
        (None, []),
    ],
)
def test_sections(spark, text, wanted):
    rows = spark.createDataFrame([(text,)], "x string").select(C.markdown_sections(F.col("x"))).first()[0]
    assert [tuple(r) for r in rows] == wanted


def test_placeholders(spark):
    assert cleaned(spark, "none\n## A\n- None.\n- n/a\n## B\n- None\n- Dental", C.without_placeholders) == "none\n\n## B\n- None\n- Dental"
    assert cleaned(spark, "## A\n\n## B\nNo additional benefits.", C.without_placeholders) == ""
    once = cleaned(spark, "x\n## A\nNone\n## B\ny", C.without_placeholders)
    assert cleaned(spark, once, C.without_placeholders) == once


def test_mandatory_wishes(spark):
    move = lambda x: cleaned(spark, x, C.mandatory_wishes_moved)
    assert move("## Nice to have\n- French\n- Must be 18\n## Qualifications\n- A") == "## Nice to have\n- French\n\n## Qualifications\n- A\n\n- Must be 18"
    assert move("## Nice to have\n- Must be 18") == "## Qualifications\n- Must be 18"
    assert move("## Nice to have\nmust be 18") == "## Nice to have\nmust be 18"
    assert move("") == ""


def test_small_values(spark):
    rows = spark.createDataFrame([("Clerk (a",), ("a) (b)",), (None,)], "x string").select(C.open_parenthesis(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True, False, None]
    rows = spark.createDataFrame([("[]",), ("[",), ("{}",), ("null",), (" ",), (None,)], "x string").select(C.json_state(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["array", "malformed", "other", "other", "empty", "empty"]
    tags = F.array(*map(F.lit, ("it", "Cook", "IT ", "nursing")))
    assert spark.range(1).select(C.known_tags(tags, ["Nursing", "IT"])).first()[0] == ["IT", "Nursing"]
