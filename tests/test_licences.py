from pyspark.sql import functions as F

from harborline.functions import licences as L

LINES = [
    ("Must have a valid Ontario Class \"G\" driver’s licence and meet the corporate standard", ["Ontario Class G"]),
    ("registration as Registered Nurse (RN) with the College of Nurses of Ontario", ["RN (CNO)"]),
    ("Class D licence with Z endorsement and must be able to obtain a Class C licence", ["Class DZ", "Class C"]),
    ("Class C licence with Z endorsement", ["Class C with Z endorsement"]),
    ("P.Eng. designation or eligible for registration with PEO", ["P.Eng. (PEO) or eligible"]),
    ("Member of the college (in good standing; no conditions) and holder of a DZ driver license", ["Class DZ"]),
    ("Must be a CNO member (no conditions; none); Valid driver's licence", ["CNO", "Driver's licence"]),
    ("Ability to obtain a B.C. driver's licence", ["Driver's licence (able to obtain)"]),
    ("Valid British Columbia driver's licence or equivalent", ["BC driver's licence or equivalent"]),
    ("Driver's licence is an asset", []), ("Software licence management", []), ("Registered as a full-time student", []), ("A class 99 licence must be held", []), ("Law Society member [formerly; Upper Canada", ["Law Society of Ontario"]), ("", []), (None, None),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string")
    got = [r[1] for r in df.select("i", L.licence_labels(F.lit("required"), F.col("t")).alias("v")).orderBy("i").collect()]
    assert [(c[0], g) for c, g in zip(LINES, got)] == LINES


def test_sections_and_cues(spark):
    df = spark.createDataFrame([("other", "Class G licence"), ("other", "Must hold a class G licence"), ("benefits", "Must hold a class G licence"), ("optional", "Class G licence")], "s string, t string")
    assert [r[0] for r in df.select(L.licence_labels(F.col("s"), F.col("t"))).collect()] == [[], ["Class G"], [], []]


def test_clauses_end_outside_brackets_only(spark):
    cases = {"a; b (c; d); e": ["a", "b (c; d)", "e"], "a [b. C]. D. e": ["a [b. C].", "D. e"], "a) ; b": ["a)", "b"], "(a; b": ["(a; b"], "": [], "a": ["a"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", L.clauses(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_weaker_labels_go(spark):
    cases = [
        (["Driver's licence", "Class G", "Ontario Class G"], ["Ontario Class G"]), (["RN (CNO)", "Registered Nurse (RN)", "CNO"], ["RN (CNO)", "Registered Nurse (RN)"]), (["Class G", "Class G"], ["Class G"]), (["Class G", "Class DZ"], ["Class DZ", "Class G"]), ([], []),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, v array<string>")
    assert [r[1] for r in df.select("i", L.without_weaker(F.col("v")).alias("w")).orderBy("i").collect()] == [w for _, w in cases]
