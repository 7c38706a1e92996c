import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.functions import dates, html, text
from harborline.operators.merge import merge
from harborline.operators.ranking import quotas, stable_sample, streaks, top_per_group


def value(spark, column, *literals):
    df = spark.createDataFrame([literals], ", ".join(f"c{i} string" for i in range(len(literals))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(literals)))).alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [("2026/3/9", "2026-03-09"), ("19/04/2026", "2026-04-19"), ("Feb 30, 2026", None), ("5-Nov-25", "2025-11-05"), ("Monday, March 3rd, 2025 at noon", "2025-03-03"), ("2025-06-01T10:00:00Z", "2025-06-01"), ("04/05/2025", "2025-04-05"), ("1999-01-01", None), ("", None), (None, None), ("soon", None)])
def test_normalize_date(spark, given, want):
    got = value(spark, lambda c: dates.normalize_date(c, F.lit(dt.date(2026, 1, 1))), given)
    assert got == (want and dt.date.fromisoformat(want))


@pytest.mark.parametrize("f, given, want", [
    (text.slug, "St. John's_Board", "st-johns-board"), (text.fix_case, "ACME WORKS", "Acme Works"), (text.fix_case, "Acme", "Acme"), (text.stable_hash, "abc", 440920331),
    (text.number, "$80,000.50 - 90,000", 80000.5), (text.number, "n/a", None), (text.collapse, " a  b\n", "a b"), (text.blank_to_null, " ", None), (text.flag, "", None), (text.flag, "yes", 1), (text.flag, "0", 0),
    (text.json_strings, '["a",1]', ["a"]), (text.json_strings, "not json", []), (text.json_strings, '{"a":1}', []), (text.json_strings, None, []), (text.string_list, "a, b;;c ", ["a", "b", "c"]), (text.placeholder_to_null, " N/A ", None),
    (html.page_text, "<nav>x</nav><p>a&amp;b</p><!-- <p> --><script>y</script> c", "a&b c"), (html.page_title, "<title>\n A &lt; B</title>", "A < B"), (text.slug, None, None), (text.collapse, "", ""),
])
def test_text_functions(spark, f, given, want):
    assert value(spark, f, given) == want


def test_merge_rules(spark):
    schema = "id long, title string, hours string, tries int"
    old = spark.createDataFrame([(1, "A", "35", 1), (2, "B", "20", 2)], schema)
    new = spark.createDataFrame([(1, "", "", 1), (3, "C", None, 1)], schema)
    got = {r["id"]: tuple(r)[1:] for r in merge(old, new, "id", {"title": "replace", "hours": "keep_if_blank", "tries": "increment"}).collect()}
    assert got == {1: ("", "35", 2), 2: ("B", "20", 2), 3: ("C", None, 1)}


def test_ranking(spark):
    df = spark.createDataFrame([("a", i, i % 4 != 0) for i in range(9)] + [("b", 100, True)], "g string, i int, ok boolean")
    assert sorted((r["g"], r["i"]) for r in top_per_group(df, ["g"], [F.desc("i")], 2).collect()) == [("a", 7), ("a", 8), ("b", 100)]
    assert [r["streak"] for r in streaks(df.filter("g = 'a'"), ["g"], ["i"], F.col("ok")).orderBy("i").collect()] == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    many = spark.createDataFrame([("x", 0), ("y", 1)] + [("z", i) for i in range(2, 100)], "g string, i int")
    q = quotas(many, "g", 0.02)
    assert {r["g"]: r["quota"] for r in q.collect()} == {"x": 1, "y": 1, "z": 1}
    sample = stable_sample(many, "g", "i", q)
    assert sample.count() == 3 and sorted(sample.collect()) == sorted(stable_sample(many.repartition(5), "g", "i", q).collect())


def test_links(spark):
    got = spark.createDataFrame([('<a class="x" href="/a">A <b>1</b></a> <A HREF="/b">B</A>',)], "h string").select(html.links(F.col("h")).alias("l")).first()["l"]
    assert [tuple(x) for x in got] == [("/a", "A 1"), ("/b", "B")]
