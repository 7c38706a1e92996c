import numpy as np

from harborline.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string"


def noise(seed, n=1200):
    return "".join(np.random.default_rng(seed).choice(list("qxzjkvwp  "), n))


def kept(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0] for r in quality_rules.quality_rules(df, carry=["doc_id"]).select("doc_id", "quality.kept").collect() if r[1]}


def test_a_label_of_junk_excuses_no_other(spark, prose):
    rows = [(i, prose(200, 1000 + i), "en") for i in range(60)]
    rows += [(100 + i, noise(i), None) for i in range(20)]
    rows += [(200 + i, noise(50 + i), "en") for i in range(3)]
    got = kept(spark, rows)
    assert got & set(range(60)) == set(range(60)) and not got & {200, 201, 202}


def test_every_character_counts(spark, prose):
    """Noise behind the last full block, and noise in less than half of a long text."""
    rows = [(i, prose(200, 1000 + i), "en") for i in range(60)]
    text = prose(400, 5)
    rows += [(100, text[:256] + noise(1, 127), "en"), (101, prose(400, 6)[:1800] + noise(2, 1300), "en")]
    assert kept(spark, rows) == set(range(60))
