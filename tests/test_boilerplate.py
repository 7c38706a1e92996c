from harborline.operators.boilerplate import by_rules, without_ends

DDL = "id int, source string, text string"


def test_ends_are_learnt_by_source_and_copies_teach_nothing(spark):
    rows = [(i, "a", f"Line {i}\n\nWe thank ALL.\nApply online!") for i in range(3)] + [(3, "a", "Other\napply   online"), (4, "a", "Apply online."), (5, "b", "Line 1\nWe thank all\nApply online")]
    rows += [(10 + i, "b", "Same\ntext\nhere") for i in range(5)] + [(20 + i, None, f"n{i}\nend") for i in range(3)] + [(30, "a", None), (31, "a", " \n ")]
    got = {r["id"]: (r["text"], r["cut"]) for r in without_ends(spark.createDataFrame(rows, DDL), "id", "source", "text", 2).collect()}
    assert [got[i] for i in range(3)] == [(f"Line {i}", 2) for i in range(3)]
    assert got[3] == ("Other", 1) and got[4] == ("Apply online.", 0) and got[5] == ("Line 1\nWe thank all\nApply online", 0)
    assert got[10] == ("Same\ntext\nhere", 0) and got[20] == ("n0", 1) and got[30] == got[31] == ("", 0) and len(got) == len(rows)
    assert without_ends(spark.createDataFrame([], DDL), "id", "source", "text").count() == 0


def test_rules(spark):
    rules = spark.createDataFrame([(None, "line", "apply online"), ("a", "tail", "We thank all")], "source string, kind string, phrase string")
    rows = [(1, "a", "x\nPlease apply online!\nWe thank all of you\ny"), (2, "b", "x\nWe thank all\napply onlines"), (3, None, "Apply online\nz"), (4, "a", None)]
    df = spark.createDataFrame(rows, DDL)
    assert {r["id"]: r["text"] for r in by_rules(df, "id", "source", "text", rules).collect()} == {1: "x", 2: "x\nWe thank all\napply onlines", 3: "z", 4: ""}
    assert by_rules(df, "id", "source", "text", rules.limit(0)).count() == 4
