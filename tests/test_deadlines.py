import datetime as dt

from pyspark.sql import functions as F

from harborline.functions import deadlines as D

AS_OF = dt.date(2026, 1, 1)
march = lambda d: dt.date(2026, 3, d)
CLOSING = [
    ("The licence expires 5 years after issue.", None, "not_checked"), ("Apply by 3 means: mail or phone", None, "not_checked"), ("There is no date set for the picnic", None, "not_checked"),
    ("Submit your resume to HR by March 3, 2026", march(3), "known"), ("Posting period: Feb 1, 2026 to March 3, 2026", march(3), "known"), ("Our deadline is on March 3, 2026", march(3), "known"), ("Closing date: March 5", march(5), "known"),
    ("Time left to apply 2 days End Date: March 3, 2026", march(3), "known"), ("Job Closing Date (3/3/2026)", march(3), "known"), ("Closing Date (internal): 2026 / 3 / 3", march(3), "known"), ("Application closes Mar. 3, 2026", march(3), "known"),
    ("Expires on Tuesday, March 3rd, 2026", march(3), "known"), ("Closing date: 3-Mar-2026", march(3), "known"), ("Deadline: March 32, 2026 or apply by March 3, 2026", march(3), "known"), ("closing date ​: March 3, 2026", march(3), "known"),
    ("Deadline: 99-99-2026", None, "invalid"), ("Closing date: N/A", None, "invalid"), ("Closing date: ongoing", None, "open_until_filled"), ("Ongoing until a suitable candidate found", None, "open_until_filled"), ("remain open until filled", None, "open_until_filled"),
    ("No closing date", None, "not_listed"), ("Closing date Apply now", None, "not_listed"), ("Posted on March 3, 2026", None, "not_checked"), ("Deadline: March 3, 2046", None, "not_checked"), ("", None, "not_checked"), (None, None, "not_checked"),
]
START = [
    ("The start date is July 1, 2027 or later", "2027-07-01"), ("Expected start date will be January, 2027", "January 2027"), ("Start date: ASAP", "Immediate"), ("Start Date: End Date: 2026-05-01", None), ("prior to start date: 2026-05-01", None),
    ("Prior to the anticipated start date: 2026-05-01", "2026-05-01"), ("Start date: unknown. Position Start Date: Winter Semester 2027", "Winter 2027"), ("Work start date - 5/4/2026", "2026-05-04"), ("no label 2026-05-01", None), (None, None),
]
PAY = [
    ("A salary of $80,000 - $90,000 per year is paid", "$80,000 - $90,000 per year"), ("Donations of $5 " + "x" * 120 + " wage $21.50/hr", "$21.50/hr"), ("$5 " + "x" * 150, None), ("Hourly: $20", "$20"), ("Pay 20", None), (None, None),
]


def results(spark, cases, f):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_closing_dates(spark):
    got = results(spark, CLOSING, lambda t: D.closing(t, F.lit(AS_OF)))
    assert [(c[0], *g) for c, g in zip(CLOSING, got)] == CLOSING


def test_start_dates(spark):
    got = results(spark, START, lambda t: D.start_date(t, F.lit(AS_OF)))
    assert [(c[0], g) for c, g in zip(START, got)] == START


def test_pay(spark):
    got = results(spark, PAY, D.pay_text)
    assert [(c[0], g) for c, g in zip(PAY, got)] == PAY


def test_matches_have_their_places(spark):
    text = "é1 22 x333"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(D.matches(F.col("t"), r"\d+").alias("m")).collect()
    assert [(m["start"], m["end"], m["text"]) for m in got[0]["m"]] == [(1, 2, "1"), (3, 5, "22"), (7, 10, "333")] and got[1]["m"] == []
