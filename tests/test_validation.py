import json

import pytest
from pyspark.sql import functions as F

from harborline.functions import validation as V

TAGS = ("data", "teamwork")
ROWS = {
    1: {"job_title": "Clerk", "department": "FINANCE OFFICE", "closing_date": "2026-03-05", "duration": "up to 3 years", "salary_min": 5, "salary_max": "3", "union_name": "Non-union", "is_unionized": "yes", "language_requirements": ["French", "English", "French"]},
    2: {"job_title": "Nurse", "closing_date": "soon", "hours": {"a": 1}, "vehicle_required": "required", "required_skills": ["Fluent in French", "Licensed trades", "Excel", None], "license_requirements": ["RN"], "responsibility_tags": ["data", "other"]},
    3: {"job_title": "  "}, 4: [1], 5: {"job_title": "Guide", "work_model": "moon", "required_skills": ["Licensed trades"], "experience_requirements": "x" * 300},
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(k, json.dumps(v), "x") for k, v in ROWS.items()] + [(6, None, "x"), (7, "", "x"), (8, "{", "x"), (5, json.dumps(ROWS[5]), "y")]
    df = spark.createDataFrame(rows, "id int, captured string, row string")
    return V.validated(df, "id", "captured", TAGS, F.lit("2026-01-01").cast("date"))


def test_typed_fields(checked):
    got = {r["id"]: r for r in V.accepted_rows(checked, "id").collect()}
    assert set(got) == {1, 2, 5} and V.accepted_rows(checked, "id").count() == 4
    a, b = got[1], got[2]
    assert (a["department"], str(a["closing_date"]), a["duration"], a["salary_min"], a["salary_max"]) == ("Finance Office", "2026-03-05", "Up to 3 years", 5.0, 3.0)
    assert (a["union_name"], a["is_unionized"], a["language_requirements"], a["work_model"]) == (None, 0, ["English", "French"], None)
    assert (b["vehicle_required"], b["required_skills"], b["responsibility_tags"], b["hours"]) == (1, ["Excel"], ["data"], None)
    assert got[5]["required_skills"] == ["Licensed trades"] and got[5]["work_model"] == "On-site"


def test_issues(checked):
    got = sorted(tuple(r) for r in V.issue_rows(checked, "id").distinct().collect())
    assert got == [
        (1, True, "language_requirements", "repeated", 1), (1, True, "salary_min", "order", 1), (1, True, "union_name", "unreadable", 1),
        (2, True, "closing_date", "unreadable", 1), (2, True, "required_skills", "refused", 2), (2, True, "required_skills", "unreadable", 1), (2, True, "responsibility_tags", "refused", 1),
        (3, False, "job_title", "missing", 1), (4, False, "row", "unreadable", 1), (5, True, "experience_requirements", "refused", 1), (5, True, "work_model", "assumed", 1),
        (6, False, "row", "unreadable", 1), (7, False, "row", "unreadable", 1), (8, False, "row", "unreadable", 1),
    ]


def test_counts_add_up(checked, spark):
    lost = {r["field"]: r["n"] for r in V.issue_rows(checked, "id").filter("accepted AND kind IN ('unreadable', 'repeated', 'refused')").groupBy("field").agg(F.sum("entries").alias("n")).collect()}
    for r in V.field_counts(checked).collect():
        assert r["given"] - r["kept"] == lost.get(r["field"], 0), r
    empty = V.validated(spark.createDataFrame([], "id int, captured string"), "id", "captured", TAGS, F.lit("2026-01-01").cast("date"))
    assert all((r["given"], r["kept"]) == (0, 0) for r in V.field_counts(empty).collect())


def test_benefits_merge_and_skills(spark):
    df = spark.createDataFrame([(["Dental", "Group dental plan", "OMERS pension"], ["Dental", "Gym"]), ([], ["Gym"]), (["A", "A"], [])], "s array<string>, n array<string>")
    assert [r[0] for r in df.select(V.merged_benefits(F.col("s"), F.col("n"))).collect()] == [["Group dental plan", "OMERS pension", "Gym"], ["Gym"], ["A"]]
    df = spark.createDataFrame([(["Excel", "Dental", "Gym", "Driver's licence", "Excel"], [], ["dental", "gym"], ["Runs a gym"])], "s array<string>, l array<string>, b array<string>, r array<string>")
    assert df.select(V.skills_left(*map(F.col, "slbr"))).first()[0] == ["Excel", "Gym"]
    df = spark.createDataFrame([(["a"], []), (["a"], ["b", "b"])], "s array<string>, e array<string>")
    assert [r[0] for r in df.select(V.reconciled(F.col("s"), F.col("e"))).collect()] == [["a"], ["b"]]
