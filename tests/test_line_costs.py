"""Steps on the lines of long texts: nothing is computed a second time by a filter that Spark pushes down."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from harborline.functions import sections, text


def filters(df) -> list[str]:
    """The conditions of all filters in the optimized plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]


#: By finding: F15, F3, F4, F6, F7, F12, F13, F14, F17, F19, F9, F10, F11, F8, F5.
QUERIES = ("section_lines", "first_aid_labels", "languages_required", "narrower_bullets", "benefits_and_certificates_named", "security_required", "licences_required", "typing_skills", "experience_required", "software_required", "filtered_by_address", "education_filters", "education_required", "posting_details", "restatements_removed",)


@pytest.mark.parametrize("name", QUERIES)
def test_no_filter_computes_texts(spark, name):
    df = __spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR)
    assert [x for x in filters(df) if "regexp_" in x] == []


def test_lines_by_kind(spark):
    """Line ends, marks and unusual white space as before the cheap tests came in front."""
    given = "A b  c\r\n-  x\r\r\nDUTIES \r\n*Skills:*\n - y\n# \n###  Benefits ##\n12\n-\r"
    got = sections.lines(spark.createDataFrame([(1, given), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("line").collect()
    assert [(r["line"], r["text"], r["is_heading"], r["section"]) for r in got] == [
        (0, "A b c", False, "other"), (1, "x", False, "other"), (2, "duties", True, "other"), (3, "skills", True, "required"), (4, "- y", False, "required"), (5, "#", False, "required"), (6, "benefits ##", True, "benefits"), (7, "12", False, "benefits"),
    ]


def test_collapse(spark):
    odd = ["a b", " a  b ", "a\tb", "a b", "a 　b﻿", " ", "é ü", "", None, "a​b"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", text.collapse(F.col("x"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["a b", "a b", "a b", "a b", "a b", "", "é ü", "", None, "a​b"]


def test_stems():
    assert text.stems(("first aid", "p.eng", "c#"), ("firstaid",)) == ("c#", "eng", "first")


def test_repeats_make_keys_once(spark):
    """Each line's key is made in one place of the plan, not again for every line."""
    df = spark.createDataFrame([("- A\n- a.\nb\n\n- c\n* A",)], "t string").select(sections.without_repeats(F.col("t")).alias("t"))
    assert df.first()["t"] == "- A\nb\n\n- c"
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_paragraphs_without_a_town_end_early(spark):
    """Advertisements are only looked for where a town is mentioned."""
    from harborline.functions import overviews

    title = F.struct(F.lit("plant operator").alias("core"), F.lit("plant operator").alias("head"))
    given = [("A vibrant city. We hire.", True), ("A vibrant city. You will see.", False), ("A vibrant city. A plant operator is here.", False), ("We hire. Apply.", False), ("The population of 50 lives. It is so.", True)]
    df = spark.createDataFrame(given, "p string, want boolean").select(overviews.is_advertisement(F.col("p"), title).alias("ad"), "want")
    assert [r for r in df.collect() if r["ad"] != r["want"]] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("vibrant") < plan.index("split(")


def test_quick_patterns_match_the_same():
    """The patterns with common beginnings find what the lists of alternatives find."""
    import re

    from harborline.functions import deadlines as D

    text = "Closing date: Thurs. Sept. 9, 2026; apply before sept 3 or Wednesday 2026-1-2, 5-mar-2026; deadlines, deadline to apply by Mayor 3, May 3. " + " x ".join(D.ALL_LABELS) + " Jan 1 januar 5 monday, 3/4/21 decoy 12"
    for quick, plain in ((D.QUICK_LABEL, D.LABEL), (D.QUICK_DATE, D.DATE)):
        found = [m.span() for m in re.finditer(plain, text)]
        assert found and [m.span() for m in re.finditer(quick, text)] == found
        assert quick.startswith(r"(?i)\b(?=[")


def test_rows_are_parsed_once(spark):
    from harborline.functions import titles, validation

    df = spark.createDataFrame([(1, '{"job_title": " Clerk ", "hours": "N/A", "benefits": ["a", 1]}'), (2, "[1]")], "k int, c string")
    checked = validation.validated(df, "k", "c", (), F.lit("2026-01-01").cast("date"))
    rows = validation.accepted_rows(checked, "k").select("k", "job_title", "hours", "benefits")
    assert [tuple(r) for r in rows.collect()] == [(1, "Clerk", None, ["a"])]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    title = df.select(titles._without_first_kind(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert title.count("[-\\s]+") < len(titles.OPENERS)  # not once a phrase
