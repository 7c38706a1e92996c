from pyspark.sql import functions as F

from harborline.functions import overviews as O

AD = "Our city is a vibrant community with a growing economy."
WORK = "The Water Operator runs the plant. Duties are many."
CASES = [
    (f"{AD} It offers quality of life.\n\n{WORK}", "Water Operator (Temporary)", WORK),
    (f"{AD} {WORK}", "Water Operator", WORK),
    (f"We care. {WORK} {AD}", "Water Operator, Plant", f"{WORK} {AD}"),
    (f"About us.\n\nAbout the role:\n\n{WORK}", "Water Operator", WORK),
    ("The opportunity: You will lead. We talk.", None, "You will lead. We talk."),
    (f"{AD} Known as the best. You will provide support.\n\n{AD}", "", "You will provide support."),
    (AD, "Nobody", AD),
    ("no sentence here\n\nnor here", "Nobody", "no sentence here\n\nnor here"),
    ("A park. A plant. Known as the best town.", "Clerk", "A park. A plant. Known as the best town."),
    ("", "Clerk", ""),
    (None, None, ""),
]
FURNITURE = [
    ("- Skip to main content\nA line\nPrint", "A line"), ("Learn more about us on LinkedIn.\n\nA paragraph\n- Apply now", "A paragraph"), ("Apply now to join", "Apply now to join"),
    ("We are an Equal Opportunity Employer.\nSecond line\n\nRest", "Rest"), ("Follow us on Facebook.\nCookie policy.", ""), ("", ""), (None, ""),
]


def test_overviews(spark):
    df = spark.createDataFrame([(i, o, t) for i, (o, t, _) in enumerate(CASES)], "i int, o string, t string")
    got = [r[1] for r in df.select("i", O.clean_overview(F.col("o"), F.col("t")).alias("r")).orderBy("i").collect()]
    assert [(*c[:2], g) for c, g in zip(CASES, got)] == CASES


def test_furniture(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(FURNITURE)], "i int, b string")
    got = [r[1] for r in df.select("i", O.without_furniture(F.col("b")).alias("r")).orderBy("i").collect()]
    assert [(c[0], g) for c, g in zip(FURNITURE, got)] == FURNITURE


def test_sentences_lose_nothing(spark):
    text = "A. B! Is it? Yes, it is. 3 dogs. no capital. “Quoted.” End"
    (got,) = spark.createDataFrame([(text,)], "t string").select(O.sentences(F.col("t"))).first()
    assert " ".join(got) == text and len(got) == 6
