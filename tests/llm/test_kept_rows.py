import os
import random

from harborline.llm import quality_rules
from harborline.llm.common import shared_dir


def folders(spark):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if not x.startswith(".")}


def test_only_the_list_of_kept_rows_is_left(spark, prose):
    """The stage's tables of texts and tokens are gone before the next stage; rows with one id go by their own texts."""
    texts = [prose(120, 7000 + i) for i in range(20)]
    rows = [(i, t, None if i % 2 else "und", 1) for i, t in enumerate(texts)] + [(None, texts[0], "und", 2), (3, "too short", "und", 3), (3, texts[3], None, 4), (5, None, "und", 5), (None, None, None, 6)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept_id int").repartition(3)
    before, tables = folders(spark), {t.name for t in spark.catalog.listTables()}
    got = quality_rules.passing(df)
    assert {x.split("-")[0] for x in folders(spark) - before} == {"kept"}
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.filter("kept_id NOT IN (3, 5, 6)").collect()))
    judged = quality_rules.quality_rules(df).filter("quality.kept").drop("quality")
    assert sorted(map(str, got.collect())) == sorted(map(str, judged.collect()))
