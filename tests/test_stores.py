from pyspark.sql import functions as F

from harborline.operators import stores


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, v string")


def test_move_is_whole_and_repeatable(spark):
    current, archive = frame(spark, [(1, "a"), (2, "b"), (3, "c")]), frame(spark, [(9, "z")])
    keys = frame(spark, [(2, ""), (7, "")])
    left, right = stores.move(current, archive, keys, "id")
    assert sorted(r["id"] for r in left.collect()) == [1, 3] and sorted(r["id"] for r in right.collect()) == [2, 9]
    again = stores.move(left, right, keys, "id")
    assert [sorted(map(tuple, d.collect())) for d in again] == [sorted(map(tuple, d.collect())) for d in (left, right)]
    assert stores.move_is_whole(current, left, right, "id") and not stores.move_is_whole(current, current, right, "id")
    assert [tuple(r) for r in stores.duplicates(current, right, "id").collect()] == [(2, 2)]


def test_parity_and_schema(spark):
    a, b = frame(spark, [(1, "a"), (2, None), (3, "c")]), frame(spark, [(1, "a"), (2, ""), (4, "d")])
    assert dict(map(tuple, stores.parity(a, b, "id", ["v"]).collect())) == {1: "same", 2: "changed", 3: "only_left", 4: "only_right"}
    assert stores.schema_difference(a, b.withColumn("v", F.lit(1)).withColumn("w", F.lit(1))) == {"only_left": [], "only_right": ["w"], "retyped": ["v"]}


def test_fill_and_changes(spark):
    old = frame(spark, [(1, ""), (2, "b"), (3, None)])
    new = stores.fill_if_empty(old, frame(spark, [(1, "x"), (2, "y")]), "id", "v")
    assert sorted(map(tuple, new.select("id", "v").collect())) == [(1, "x"), (2, "b"), (3, None)]
    assert [tuple(r) for r in stores.changes(old, new, "id", "v").collect()] == [(1, "", "x")]
