import datetime as dt

from pyspark.sql import functions as F

from harborline.operators import boards as B
from harborline.plans.boards import AS_OF, PAGES


def fields(spark, rows, rules=B.RULES, as_of=AS_OF):
    df = spark.createDataFrame(rows, "id long, board string, text string")
    out = {}
    for r in B.board_fields(df, B.rules_table(spark, rules) if rules else spark.createDataFrame([], B.SCHEMA), F.lit(as_of)).collect():
        out.setdefault(r["id"], {})[r["field"]] = r["value"]
    return out


def test_boards_of_each_kind(spark, monkeypatch):
    rows = [(i, b, t) for i, (b, t) in enumerate(PAGES)]
    got = fields(spark, rows)
    assert got[0] == {"union_name": "CUPE Local 5167", "is_unionized": "true", "closing_date": "2026-03-03", "duration": "12 months", "employment_type": "Contract", "work_model": "Hybrid"}
    assert got[1] == {"union_name": "", "is_unionized": "false", "employment_type": "Permanent", "work_model": "On-site"}
    assert got[2]["closing_date"] == "2026-02-20" and got[2]["salary_low"] == "80000.00" and got[2]["salary_high"] == "95500.50" and got[2]["duration"] == "Temporary" and got[2]["department"] == "Parks"
    assert got[3]["salary"] == "$30.25 to $38.10 an hour" and got[3]["salary_period"] == "hourly" and got[3]["duration"] == "6 months" and got[3]["closing_date"] == "2026-04-09"
    assert got[4]["union_name"] == "ONA" and got[4]["employment_type"] == "Part-time" and got[4]["salary_low"] == "25.00"
    assert got[5]["department"] == "Transit" and got[5]["closing_date"] == "2026-05-01" and got[5]["employment_type"] == "Contract"
    assert got[6]["department"] == "Roads" and got[7]["employment_type"] == "Contract" and got[8]["salary_high"] == "70000.00" and got[8]["employment_type"] == "Seasonal"
    assert got[9]["location"] == "Main" and got[9]["work_model"] == "Remote" and got[10]["union_name"] == "YUSA" and got[11]["closing_date"] == "2026-08-01"
    assert got[12]["location"] == "Various" and got[13]["union_name"] == "Faculty Association" and 14 not in got and 15 not in got
    monkeypatch.setattr(B, "BROADCAST", 0)  # joined by a shuffle
    assert fields(spark, rows) == got


def test_nulls_empty_tables_and_order(spark):
    assert fields(spark, [(1, "hamilton", None), (2, None, "Union: X"), (3, "adp", "")]) == {1: {"employment_type": "Permanent", "work_model": "On-site"}}
    assert fields(spark, []) == {} and fields(spark, [(1, "adp", "Department: X")], ()) == {}
    rules = [*B._labels("b", "x", "text", "Second Label", "First"), *B._labels("b", "when", "date", "Closes")]
    text = "First: one\nSome Second Label: two\nSecond Label: three\nCloses: tomorrow\nCloses: 2026-02-30\nCloses: Feb 3, 2026\nLast label"
    assert fields(spark, [(1, "b", text)], rules, dt.date(2026, 1, 1)) == {1: {"x": "two", "when": "2026-02-03"}}
