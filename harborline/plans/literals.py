"""Text functions on literal cases that the tables don't hold; the SQL states the wanted values."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions import captures, dates, deadlines, durations, pay, schedules, terms, text, titles
from harborline.plans.registry import query

AS_OF = dt.date(2026, 1, 1)


def cases(name: str, f: Callable[[Column], Column], pairs: list[tuple[str | None, str | None]]) -> None:
    """A query (n, given, result) of ``f`` on each given text."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(pairs))

    @query(name, f"SELECT n::INTEGER AS n, given::VARCHAR AS given, result::VARCHAR AS result FROM (VALUES {rows}) AS t(n, given, result)")
    def run(spark, sf_dir):
        given = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "n int, given string")
        return given.select("n", "given", f(F.col("given")).cast("string").alias("result"))


cases("date_ladder", lambda c: dates.normalize_date(c, F.lit(AS_OF)), [("2026/3/9", "2026-03-09"), ("19/04/2026", "2026-04-19"), ("Feb 30, 2026", None), ("5-Nov-25", "2025-11-05"), ("Tuesday, 3 March 2026", "2026-03-03"), ("2025-06-01T10:00:00Z", "2025-06-01"), ("1999-01-01", None), ("", None), (None, None)])
cases("duration_norm", durations.duration, [("Indeterminate", "Permanent"), ("up to 3 years", "Up to 3 years"), ("May - August 2027", "2027-05-01 to 2027-08-31"), ("10 month work year", "10-month work year"), ("Winter 2027 term", "Winter 2027"), ("casual", "Term"), ("n/a", ""), (None, "")])
cases("hours_norm", schedules.hours, [("max 20 hrs per week", "Up to 20 hours per week"), ("35 hours per week", "35 hours per week"), ("37.5/week", "37.5 hours per week"), ("36 hours (3 credits)", "36 hours"), ("shift work", ""), (None, "")])
cases("availability_norm", schedules.availability, [("nights and holidays", "Nights; Holidays"), ("Days, evenings and weekends", "Evenings; Weekends"), ("Monday to Friday", "Mon-Fri"), ("full-time", ""), (None, "")])
cases("salary_period_norm", terms.salary_period, [("per course", "flat"), ("$20/hr", "hourly"), ("per month", "monthly"), ("annual", "yearly"), ("", "yearly"), (None, "yearly")])
cases("work_model_norm", terms.work_model, [("work from home", "Remote"), ("Blended", "Hybrid"), ("office", "On-site"), (None, "On-site")])
cases("employment_type_norm", terms.employment_type, [("Supply", "Occasional"), ("Seasonal help", "Seasonal"), ("part time", "Part-time"), ("continuing", "Permanent"), ("temp", "Contract"), ("", "Full-time")])
cases("closing_status", lambda c: deadlines.closing(c, F.lit(AS_OF))["status"], [("Closing date: 2026-03-01", "known"), ("open until filled", "open_until_filled"), ("No application deadline", "not_listed"), ("Deadline: TBD", "invalid"), ("", "not_checked"), (None, "not_checked")])
cases("capture_gate", captures.capture_issue, [("", "empty"), ("Skip to main content", "unrendered"), ("NoSuchKey", "error_page"), ("please verify you are human", "bot_challenge"), ("this job has expired", "expired_page"), ("A clerk is wanted", None)])
cases("title_norm", titles.job_title, [("Clerk (Casual)", "Clerk"), ("Contract, Community Worker", "Community Worker"), ("Planner - Inventory", "Planner"), ("Casual", "Casual"), (None, "")])
cases("department_norm", titles.department, [("EECS", "EECS"), ("TRANSIT", "Transit"), ("OFFICE OF THE CAO", "Office of the CAO"), ("General", ""), (None, "")])
cases("location_norm", lambda c: titles.place(c, {"toronto": "ON", "vancouver": "BC"}), [("toronto", "Toronto, ON"), ("Nowhereville", ""), ("Toronto, ON; Vancouver", "Toronto, ON; Vancouver, BC"), (None, "")])
cases("slug_literals", text.slug, [("St. John's_Board", "st-johns-board"), ("--A  b--", "a-b"), ("", ""), (None, None)])
cases("fix_casing", text.fix_case, [("ACME WORKS", "Acme Works"), ("Acme", "Acme"), ("12", "12"), (None, None)])
cases("stable_hash", text.stable_hash, [("abc", "440920331"), (None, None)])
cases("coerce_number", lambda c: text.number(c).cast("decimal(12,2)"), [("$80,000.50 - 90,000", "80000.50"), ("n/a", None), (".5", "0.50"), (None, None)])
cases("tri_state", text.flag, [("", None), ("yes", "1"), ("0", "0"), ("maybe", None), (None, None)])
cases("json_tags_strings_only", lambda c: F.array_join(text.json_strings(c), "|"), [('["a",1,"b"]', "a|b"), ("not json", ""), ('{"a":1}', ""), (None, "")])
cases("salary_bounds", lambda c: F.concat_ws("-", *(pay.pay_range(c)[k].cast("decimal(12,2)").cast("string") for k in ("low", "high"))), [("$80,000 to $90,000.50", "80000.00-90000.50"), ("$20", "20.00-20.00"), ("none", "")])
