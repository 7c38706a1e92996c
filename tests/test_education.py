from pyspark.sql import functions as F

from harborline.functions import education as E

LINES = [
    ("Grade 12 or equivalent", "High school diploma"),
    ("Bachelor of Social Work degree", "Bachelor of Social Work degree"),
    ("Must produce verification of degree(s), credentials(s), or equivalencies from accredited institutions at interview", "Education verification"),
    ("Bachelor's degree in Corporate Communications, Media Relations, Public Relations, or related field (Master's preferred)", "Bachelor's degree in Corporate Communications, Media Relations, Public Relations, or related field"),
    ("A PhD degree (completed, in progress, near-completion, or equivalent experience) in a relevant discipline. A demonstrated interest in accessible AI.", "PhD (completed, in progress, near-completion, or equivalent experience) in a relevant discipline"),
    ("Current enrolment as a full-time student at an accredited post-secondary institution", "Current enrolment as a full-time student at an accredited post-secondary institution"),
    ("Registration in a co-op program", "Registration in a co-op program"), ("Master's degree is preferred", None), ("Master Electrician certification is required", None),
    ("Experience dealing with clients in a post-secondary or corporate setting", None), ("Demonstrated accuracy and attention to detail with a high degree of care", None), ("", None), (None, None),
]
VALUES = [
    ("AS-01 only:- Successful completion of a post-secondary diploma or degree in a law related field (already obtained OR obtained before appointment) or an acceptable combination of education, training, and/or experience", "Post-secondary diploma or degree in a law related field"),
    ("*Education:** A secondary school diploma or employer-approved alternatives", "High school diploma"),
    ("ED1: Graduation with a degree from a recognized post-secondary institution in mechanical engineering", "Degree in mechanical engineering"),
    ("Engineers (EN-ENG-03): Graduation with a degree from a recognized post-secondary institution in civil engineering", "Degree in civil engineering"),
    ("Your application must clearly explain how you meet the followingA secondary school diploma or an acceptable combination of education, training or experience**Candidates invited to an interview will be required to bring proof of their education credentials", "High school diploma"),
    ("Completion of a high school diploma – or a combination of education, training and experience deemed equivalent", "High school diploma"),
    ("Partial high school", "Partial high school"), ("Bachelor's degree in Business Administration; or", "Bachelor's degree in Business Administration"), ("Completion of two years of secondary school", "2 years of high school"),
    ("Undergraduate degree in Planning with at least five years of related experience", "Bachelor's degree in Planning"), ("Advanced college diploma (3 years) in Forestry or equivalent", "College diploma in Forestry"),
    ("High school graduation, plus a program in Law and Security", "High school diploma plus program in Law and Security"), ("Secondary school diploma and Personal Support Worker certificate", "High school diploma and Personal Support Worker certificate"),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string")
    got = [r[1] for r in df.select("i", E.education(F.lit("required"), F.col("t"))["label"]).orderBy("i").collect()]
    assert [(c[0], g) for c, g in zip(LINES, got)] == LINES


def test_values_and_their_own_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VALUES)], "i int, t string")
    once = df.select("i", E.education_label(F.col("t"))["label"].alias("t"))
    assert [r[1] for r in once.orderBy("i").collect()] == [w for _, w in VALUES]
    assert once.select("i", "t", E.education_label(F.col("t"))["label"].alias("u")).filter("t <> u").collect() == []


def test_sections(spark):
    df = spark.createDataFrame([("other", "Degree in law"), ("other", "Our degree in law"), ("optional", "Degree in law"), ("benefits", "Degree in law"), ("other", "We ask for high school")], "s string, t string")
    assert [r[0] for r in df.select(E.education(F.col("s"), F.col("t"))["label"]).collect()] == ["Degree in law", None, None, None, "High school diploma"]


def test_order_is_partial():
    up = E.suffices()
    assert up["doctorate"] & ~up["bachelor"] == 0 and up["bachelor"] & ~up["high_school"] == 0
    assert up["law"] & ~up["master"] and up["master"] & ~up["law"] and up["diploma"] & ~up["degree"] and up["degree"] & ~up["diploma"]
    inside = lambda a, b: up[a] & ~up[b] == 0
    assert not any(inside(a, b) and inside(b, a) for a in up for b in up if a != b)


def test_implied_labels_go(spark):
    cases = [
        (["High school diploma", "Bachelor's degree in Law"], ["Bachelor's degree in Law"]), (["Bachelor's degree", "Bachelor's degree in Law"], ["Bachelor's degree in Law"]),
        (["Diploma in Art", "Master's degree in Law"], ["Diploma in Art", "Master's degree in Law"]), (["Degree in law", "PhD in Law"], ["PhD in Law"]), (["Degree or diploma in law", "PhD"], ["Degree or diploma in law", "PhD"]),
        (["Diploma or degree", "High school diploma", "Degree or diploma"], ["Diploma or degree", "Degree or diploma"]), (["2 years of high school", "High school diploma", "Education verification"], ["High school diploma", "Education verification"]), (["PhD", "PhD"], ["PhD"]), ([], []),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, v array<string>")
    got = df.select("i", E.without_implied(F.transform("v", E.education_label)).alias("w")).orderBy("i").collect()
    assert [r[1] for r in got] == [w for _, w in cases]
