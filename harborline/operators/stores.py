"""Current and archive stores of one schema: moves, duplicates, parity and bounded plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ranking import running_totals


def move(source: DataFrame, target: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(source without, target with) the rows whose ``key`` is in ``keys``. Moving twice changes nothing:
    rows that the target has already are not added again."""
    moved = source.join(keys.select(key).distinct(), key, "left_semi")
    new = moved.join(target.select(key), key, "left_anti")
    return source.join(keys.select(key).distinct(), key, "left_anti"), target.unionByName(new, allowMissingColumns=True)


def move_is_whole(before: DataFrame, after: DataFrame, target: DataFrame, key: str) -> bool:
    """Whether every key of ``before`` is in exactly one of the two stores afterwards."""
    places = after.select(key, F.lit(1).alias("n")).unionByName(target.select(key, F.lit(1).alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))
    return before.select(key).distinct().join(places, key, "left").filter(F.coalesce("n", F.lit(0)) != 1).isEmpty()


def duplicates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once in both stores together."""
    return a.select(key).unionByName(b.select(key)).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns of one side only, and those of both with different types."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"only_left": sorted(set(x) - set(y)), "only_right": sorted(set(y) - set(x)), "retyped": sorted(c for c in set(x) & set(y) if x[c] != y[c])}


def row_hash(columns: list[str]) -> Column:
    """sha256 of the values as text; null and empty text differ."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns)), 256)


def parity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state) of every key: same, changed, only_left or only_right."""
    x = a.select(key, row_hash(columns).alias("x"))
    y = b.select(key, row_hash(columns).alias("y"))
    state = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return x.join(y, key, "full_outer").select(key, state.alias("state"))


def fill_if_empty(df: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` taken from ``found`` only where it is null or empty."""
    f = found.select(key, F.col(column).alias("__found"))
    old = F.nullif(F.col(column).cast("string"), F.lit(""))
    return df.join(f, key, "left").withColumn(column, F.when(old.isNull(), F.coalesce("__found", column)).otherwise(F.col(column))).drop("__found")


def changes(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, before, after) where ``column`` differs: what a correction would write."""
    o, n = old.select(key, F.col(column).alias("before")), new.select(key, F.col(column).alias("after"))
    return o.join(n, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def bounded_plan(df: DataFrame, key: str, size: Column, most_bytes: int) -> DataFrame:
    """Rows in the order of the whole-number ``key`` while their sizes sum to at most ``most_bytes``, with the running total."""
    return running_totals(df.withColumn("__size", size), key, "__size", "running_bytes").filter(F.col("running_bytes") <= most_bytes).drop("__size")


def restore(archive: DataFrame, current: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(archive without, current with) the rows of ``keys``: a move back."""
    return move(archive, current, keys, key)


def retire(store: DataFrame, children: dict[str, DataFrame], keys: DataFrame, key: str, reason: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``store`` with is_active 0 and ``reason`` at ``keys``, and ``children`` without their rows."""
    gone = keys.select(key).distinct().withColumn("__gone", F.lit(True))
    hit = F.coalesce("__gone", F.lit(False))
    marked = store.join(gone, key, "left").withColumns({"is_active": F.when(hit, 0).otherwise(F.col("is_active")), "reason": F.when(hit, reason).otherwise(F.col("reason"))}).drop("__gone")
    return marked, {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def guarded_update(df: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` set to ``after`` of ``wanted`` (key, before, after), only where it still is ``before``."""
    w = wanted.select(key, F.col("before").alias("__before"), F.col("after").alias("__after"), F.lit(True).alias("__there"))
    met = F.coalesce("__there", F.lit(False)) & F.col(column).eqNullSafe(F.col("__before"))
    return df.join(w, key, "left").withColumn(column, F.when(met, F.col("__after")).otherwise(F.col(column))).drop("__before", "__after", "__there")


def not_applied(df: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """The rows of ``wanted`` whose ``after`` isn't in ``df``: none after an update that went through whole."""
    now = df.select(key, F.col(column).alias("__now"), F.lit(True).alias("__there"))
    return wanted.join(now, key, "left").filter(F.col("__there").isNull() | ~F.col("__now").eqNullSafe(F.col("after"))).drop("__now", "__there")


def audit_log(diff: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, entry): each change of ``diff`` (key, before, after) as JSON, ready to append."""
    return diff.select(key, F.lit(field).alias("field"), F.to_json(F.struct("before", "after"), {"ignoreNullFields": "false"}).alias("entry"))


def swap_in(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at ``path`` by ``df``, which may read it: written beside it, counted, then renamed.
    The old table stays at ``path`` + ".previous" until the next swap."""
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    old, new, previous = make(path), make(f"{path}.next"), make(f"{path}.previous")
    fs = old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    df.write.mode("overwrite").parquet(f"{path}.next")
    if spark.read.parquet(f"{path}.next").count() != df.count():
        raise ValueError("the staged table isn't whole")
    fs.delete(previous, True)
    if fs.exists(old) and not fs.rename(old, previous) or not fs.rename(new, old):
        raise OSError(f"couldn't swap {path}")
