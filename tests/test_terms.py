import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.functions import captures, deadlines, schedules, terms
from tests.test_functions import value


@pytest.mark.parametrize("f, given, want", [
    (terms.salary_period, "per course", "flat"), (terms.salary_period, "$20 / hr", "hourly"), (terms.salary_period, None, "yearly"), (terms.salary_period, "per_month", "monthly"), (lambda c: terms.salary_period(c, True), "?", None),
    (terms.work_model, "work-from-home", "Remote"), (terms.work_model, "Flexible work", "Hybrid"), (terms.work_model, "", "On-site"), (lambda c: terms.work_model(c, F.lit("Tutor (Online)")), "", "Remote"),
    (terms.employment_type, "Supply teacher", "Occasional"), (terms.employment_type, "temp", "Contract"), (terms.employment_type, "impart", "Full-time"), (terms.employment_type, "part time", "Part-time"), (terms.employment_type, None, "Full-time"),
    (schedules.hours, "max 20 hrs per week", "Up to 20 hours per week"), (schedules.hours, "35 hours per week", "35 hours per week"), (schedules.hours, "37.5/week", "37.5 hours per week"), (schedules.hours, "24-hour work week", "24 hours per week"), (schedules.hours, "36 hours (3 credits)", "36 hours"), (schedules.hours, "on-call", ""), (schedules.hours, None, ""),
    (schedules.availability, "nights and holidays", "Nights; Holidays"), (schedules.availability, "Days, evenings and weekends", "Evenings; Weekends"), (schedules.availability, "Monday to Friday, daytime", "Daytime; Mon-Fri"), (schedules.availability, "full-time", ""), (schedules.availability, None, ""), (schedules.availability, "By arrangement", "By arrangement"),
    (captures.capture_issue, "  ", "empty"), (captures.capture_issue, "Skip to main content", "unrendered"), (captures.capture_issue, "please verify you are human", "bot_challenge"), (captures.capture_issue, "A real posting of a clerk", None), (captures.capture_issue, "This job has expired.", "expired_page"),
])
def test_terms(spark, f, given, want):
    assert value(spark, f, given) == want


@pytest.mark.parametrize("f", [schedules.hours, schedules.availability, terms.work_model, terms.employment_type])
def test_own_output_stays(spark, f):
    texts = ["max 20 hrs per week", "35 hours per week", "Evenings; Weekends", "Mon to Fri", "Hybrid", "Part-time", "", "casual"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t")).alias("a"))
    assert all(r["a"] == r["b"] for r in df.select("a", f(F.col("a")).alias("b")).collect())


@pytest.mark.parametrize("given, want", [("Closing Date: March 3, 2026", (dt.date(2026, 3, 3), "known")), ("No application deadline", (None, "not_listed")), ("open until filled", (None, "open_until_filled")), ("Deadline: TBD", (None, "invalid")), ("Deadline: 45/45/2026 or apply by 2026-05-01", (dt.date(2026, 5, 1), "known")), ("", (None, "not_checked")), (None, (None, "not_checked")), ("a clerk", (None, "not_checked"))])
def test_closing(spark, given, want):
    assert tuple(value(spark, lambda c: deadlines.closing(c, F.lit(dt.date(2026, 1, 1))), given)) == want


@pytest.mark.parametrize("name, flag, want", [("Non-Union", True, (False, "")), ("C.U.P.E. Local 1", False, (True, "CUPE Local 1")), ("Union", None, (True, "")), ("Collective Agreement", False, (False, "")), (None, True, (True, "")), ("Non-Academic Staff Association", False, (True, "Non-Academic Staff Association"))])
def test_union_fields(spark, name, flag, want):
    df = spark.createDataFrame([(name, flag)], "n string, f boolean")
    assert tuple(df.select(terms.union_fields(F.col("n"), F.col("f")).alias("v")).first()["v"]) == want


@pytest.mark.parametrize("title, body, student, want", [("Intern position", "", 0, "student"), ("Clerk", "entry-level", None, "early-career"), ("Manager", "manages a team", 0, "senior"), ("Manager", "a team", 0, None), ("Clerk", "at least three years", 0, "experienced"), ("", "", 1, "student"), (None, None, None, None)])
def test_career_stage(spark, title, body, student, want):
    df = spark.createDataFrame([(title, body, student)], "t string, b string, s int")
    assert df.select(terms.career_stage(F.col("t"), F.col("b"), F.col("s")).alias("v")).first()["v"] == want


@pytest.mark.parametrize("text, source, want", [
    ("La ressource que vous avez demandée n'est pas disponible", "x", "unrendered"), ("top\n 404 Not Found here", "x", "error_page"), ("Incident ID: 0a1b2c3d-99", "x", "bot_challenge"), ("page 404 not found", "x", None),
    ("Join our Talent Pool", "ICBC", "generic_portal"), ("Join our Talent Pool. Position highlights", "ICBC", None), ("Join our Talent Pool", "x", None), ("cookies", "SaskTel", "generic_portal"), ("Salary: 10", "SaskTel", None), ("cookies", None, None),
    ("Join Our Talent Community. Current Openings ( 1 of 1 )", "Government of Canada", "generic_portal"), ("Join Our Talent Community. Current Openings (1 of 1) Duties", "Government of Canada", None),
])
def test_capture_issue_by_source(spark, text, source, want):
    df = spark.createDataFrame([(text, source)], "t string, s string")
    assert df.select(captures.capture_issue(F.col("t"), F.col("s")).alias("v")).first()["v"] == want


@pytest.mark.parametrize("name, want", [("work-study", (False, "")), ("Non spécifié", (False, "")), ("Union / Non-Union", (False, "")), ("MGMT Non-Union", (False, "")), ("Nonunionized staff", (False, "")), ("N/A", (False, "")), ("Faculty Collective Agreement", (True, "")), ("Unifor 3", (True, "Unifor 3"))])
def test_union_labels(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(terms.union_fields(F.col("n"), F.lit(True)).alias("v")).first()["v"]) == want
