from pyspark.sql import functions as F

from harborline.functions import posting_fields as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_titles_and_dates(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, P.public_title(lit("Skip to main"), lit(" Nurse "))) == "Nurse" and one(spark, P.public_title(lit(""), lit(None))) is None
    assert one(spark, P.first_stated(lit("N/A"), lit(" 2001-01-02 "))) == "2001-01-02" and one(spark, P.first_stated(lit(" "), lit(None))) is None
    day = lambda p: str(one(spark, P.freshness_date(lit(p), F.lit("2001-01-05"), F.lit("2001-06-30").cast("date"))))
    assert [day(p) for p in ("2001-06-30T09:00", "2001-07-01", "soon", None)] == ["2001-06-30", "2001-01-05", "2001-01-05", "2001-01-05"]


def test_until_filled_needs_a_deadline_word(spark):
    found = [one(spark, P.open_until_filled(F.lit(t))) for t in ("until filled", "closing date: until filled", "open till filled", "filled")]
    assert found == [False, True, True, False]


def test_filters(spark):
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, P.languages_all(strings("Bilingual (EN/FR)"), ["English", "French"])) and not one(spark, P.languages_all(strings("English"), ["English", "French"]))
    assert not one(spark, P.career_stages(F.lit(None).cast("string"), ["senior"])) and one(spark, P.career_stages(F.lit(None).cast("string"), ["other"]))
    assert one(spark, P.same_set(strings("A", "b "), strings("B", "a", "a"))) and not one(spark, P.same_set(strings("a"), strings("a", "b")))
    assert one(spark, P.joined(strings("", "a", "b"))) == "a, b" and one(spark, P.joined(strings(""))) is None
    assert one(spark, P.listing_type(F.lit(None).cast("string"), F.lit(False), F.lit("our talent pool"))) == "ongoing_recruitment"
