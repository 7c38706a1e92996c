import datetime as dt

from pyspark.sql import functions as F

from harborline.functions import announcements as A

AS_OF = dt.date(2026, 6, 30)
POSTED = [
    ("Date Posted: July 9th, 2026 Closing date: Aug 1, 2026", "2026-07-09"), ("posted on Posted 10 Days Ago", None), ("Posting date (EST) - 9 February 2026", "2026-02-09"), ("Posted: Feb 30, 2026. Opening date: 2026-03-01", "2026-03-01"), ("Posted 31-Aug-25", "2025-08-31"),
    ("Advertised on Tuesday, January 6, 2026", "2026-01-06"), ("Posted July 9", None), ("Posted 01/02/2031", None), ("", None), (None, None), ("Publication date: 26/06/2026", "2026-06-26"), ("reposted 2026-01-01", None),
]
RELATIVE = [("Posted Today", "2026-06-30"), ("posted onPosted YesterdayJob requisition id", "2026-06-29"), ("posted on Posted Today time left", "2026-06-30"), ("Posted 3 Days Ago", None), ("Posted todays", None), (None, None)]
TITLES = [
    ("Planner (12-month contract)", "12-month contract"), ("Clerk - Term", "Term"), ("Analyst, up to 2 years", None), ("Analyst – approx. 18 months", "approx. 18 months"), ("Contract, Community Worker", "Contract"), ("Nurse (Permanent, Full-Time)", "Permanent"),
    ("Nurse Temporary", "Temporary"), ("Term Lender Officer", "Term"), ("Long-term care aide", None), ("Cook (3 weeks) - Casual", "3 weeks"), ("Coach ; up to 2 years", "up to 2 years"), ("", None), (None, None),
]
KINDS = [
    ("The House of Commons hires students throughout the year for diverse opportunities.", "Student Employment Program", "ongoing_recruitment"), ("We are hiring experienced dispatchers for our police dispatch program.", "Experienced 9-1-1 Police Dispatcher", "ongoing_recruitment"),
    ("The City accepts applications for this position throughout the year and hires on an as-needed basis.", "Crossing Guard", "ongoing_recruitment"), ("This posting is intended to create a candidate pool for future vacancies.", "Driver", "ongoing_recruitment"),
    ("We are recruiting 9-1-1 Police Dispatchers in British Columbia.", "9-1-1 Police Dispatchers", "ongoing_recruitment"), ("The House of Commons offers 16-week co-op placements across multiple departments.", "Co-op Students - Various Positions", "ongoing_recruitment"),
    ("We are looking to fill two positions and establish a pool of qualified candidates for future opportunities.", "Contract Coordinator", "ongoing_recruitment"), ("The role may require requests for expression of interest and other procurement methods.", "Corporate Buyer", "regular"),
    ("Applications will be accepted until filled.", "Project Coordinator", "regular"), ("The position will remain open until filled.", "Project Coordinator", "regular"), ("A hiring pool will be used for upcoming vacancies.", "Child Protection Social Worker (Hiring Pool)", "ongoing_recruitment"),
    ("Monitor the budgets throughout the year, assessing variances.", "Budget Analyst", "regular"), ("Future opportunities in this area are expected to contribute to the following responsibilities.", "Business Analyst", "regular"), ("Pool to be created\nYes\nTemporary: Term", "Clerical and Administrative Positions", "ongoing_recruitment"),
    ("Carleton University is building a pool of candidates for temporary casual assignments.", "Applicant Pool", "inventory"), ("Vacancy Type: This is for all current and future permanent part-time vacancies.", "Recreation Assistant - RE-POST (Periodic Posting)", "inventory"),
    ("The City is establishing an eligibility list of qualified applicants in anticipation of future vacancies.", "Firefighter (Eligibility List)", "inventory"), ("You are not applying for a specific job, but to an inventory; managers", "Clerk", "inventory"), (None, None, "regular"),
]


def _values(spark, cases, column):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{j} string" for j in range(len(cases[0]))))
    return [(str(r["v"]) if isinstance(r["v"], dt.date) else r["v"]) for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_posted_dates(spark):
    assert _values(spark, POSTED, A.posted_date(F.col("c0"), F.lit(AS_OF))) == [w for _, w in POSTED]
    assert _values(spark, RELATIVE, A.recently_posted(F.col("c0"), F.lit(AS_OF))) == [w for _, w in RELATIVE]


def test_durations_in_titles(spark):
    assert _values(spark, TITLES, A.title_duration(F.col("c0"))) == [w for _, w in TITLES]


def test_kinds(spark):
    assert _values(spark, KINDS, A.listing_kind(F.col("c1"), F.col("c0"), F.lit(False))) == [w for *_, w in KINDS]
    assert _values(spark, [("a", "b")], A.listing_kind(F.col("c1"), F.col("c0"), F.lit(True))) == ["inventory"]
    stored = [("Ongoing_Recruitment", "ongoing_recruitment"), ("open-until filled", "ongoing_recruitment"), ("Talent inventory ", "inventory"), ("standard", "regular"), (None, "regular")]
    assert _values(spark, stored, A.stored_kind(F.col("c0"), F.lit(False))) == [w for _, w in stored]
