"""Top rows of groups, first-wins deduplication, streaks, quotas and seeded samples."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` ends in a unique column."""
    rank = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= n).drop("__rank")


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of an ordered list; the limit stays within 1 and 100."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def streaks(df: DataFrame, group: list[str], order: list[str], good: Column, skipped: Column | None = None) -> DataFrame:
    """``df`` with ``streak``: how many good rows in a row end here (0 at a bad one). ``skipped`` rows neither count
    nor end a streak."""
    by = Window.partitionBy(*group).orderBy(*order)
    skip = F.lit(False) if skipped is None else skipped
    island = df.withColumns({"__ok": good & ~skip, "__bad": ~good & ~skip}).withColumn("__island", F.sum(F.col("__bad").cast("int")).over(by))
    run = Window.partitionBy(*group, "__island").orderBy(*order)
    return island.withColumn("streak", F.sum(F.col("__ok").cast("long")).over(run)).drop("__ok", "__bad", "__island")


def running_totals(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows up to this one by the unique whole number ``key``.

    Totals of blocks of 2**16 keys, of blocks of blocks and so on are summed first. So no task sorts more
    than 2**16 rows of one group, whatever the number of rows. Rows with a null key go.
    """
    rows = df.filter(F.col(key).isNotNull()).withColumn("__b", F.shiftright(F.col(key).cast("long"), 16))
    levels = [rows.groupBy("__b").agg(F.sum(value).alias("__v"))]
    for _ in range(2):
        levels.append(levels[-1].groupBy(F.shiftright("__b", 16).alias("__b")).agg(F.sum("__v").alias("__v")))
    base = levels.pop().select("__b", (F.sum("__v").over(Window.orderBy("__b")) - F.col("__v")).alias("__base"))
    for level in reversed(levels):
        up = base.withColumnsRenamed({"__b": "__up", "__base": "__from"})
        before = F.sum("__v").over(Window.partitionBy("__up").orderBy("__b")) - F.col("__v")
        base = level.withColumn("__up", F.shiftright("__b", 16)).withColumn("__before", before).join(up, "__up").select("__b", (F.col("__from") + F.col("__before")).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy(key))
    return rows.withColumn("__inside", inside).join(base, "__b").withColumn(out, F.col("__base") + F.col("__inside")).drop("__b", "__inside", "__base")


def _deal(t: DataFrame, room: str, amount: str, order: list[Column], out: str) -> DataFrame:
    """``t`` with ``out``: what each row gets of ``amount`` when it is dealt one at a time, in ``order`` and round after
    round, to rows with ``room`` left. Whole rounds are found from the sums of room below each level."""
    whole = Window.partitionBy()
    upto = Window.orderBy(room).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.sum(room).over(upto) + F.col(room) * (F.count("*").over(whole) - F.count("*").over(upto))
    t = t.withColumn("__level", level)
    met = F.col("__level") <= F.col(amount)
    t = t.withColumns({"__full": F.coalesce(F.max(F.when(met, F.col(room))).over(whole), F.lit(0)), "__spent": F.coalesce(F.max(F.when(met, F.col("__level"))).over(whole), F.lit(0))})
    t = t.withColumn("__above", F.count(F.when(F.col(room) > F.col("__full"), 1)).over(whole))
    more = F.when(F.col("__above") > 0, F.floor((F.col(amount) - F.col("__spent")) / F.col("__above"))).otherwise(0)
    t = t.withColumn("__full", F.col("__full") + more).withColumn("__left", F.col(amount) - F.col("__spent") - more * F.col("__above"))
    place = F.row_number().over(Window.orderBy((F.col(room) > F.col("__full")).desc(), *order))
    t = t.withColumn("__place", place)
    got = F.least(F.col(room), F.col("__full")) + ((F.col(room) > F.col("__full")) & (F.col("__place") <= F.col("__left"))).cast("long")
    return t.withColumn(out, got).drop("__level", "__full", "__spent", "__above", "__left", "__place")


def quotas(df: DataFrame, group: str, share: float) -> DataFrame:
    """(group, n, quota): rows to take of each group so that every group is seen and the whole comes to
    ceil(share * rows), if there are not more groups than that.

    A group gets its whole share, one row at least. What is missing goes to the largest remainders, what is too
    much comes from the smallest, one row at a time and round after round. Windows without a key see one row a group.
    """
    whole = Window.partitionBy()
    t = df.groupBy(group).agg(F.count("*").alias("n"))
    t = t.withColumn("__all", F.sum("n").over(whole)).withColumn("__target", F.ceil(F.col("__all") * share))
    t = t.withColumn("__rest", (F.col("n") * F.col("__target")) % F.col("__all")).withColumn("__least", F.least(F.col("n"), F.greatest(F.lit(1), F.expr("n * __target div __all"))))
    gap = F.col("__target") - F.sum("__least").over(whole)
    t = t.withColumns({"__missing": F.greatest(gap, F.lit(0)), "__excess": F.greatest(-gap, F.lit(0)), "__room": F.col("n") - F.col("__least"), "__spare": F.col("__least") - 1})
    t = _deal(t, "__room", "__missing", [F.desc("__rest"), F.asc(group)], "__more")
    t = _deal(t, "__spare", "__excess", [F.asc("__rest"), F.asc(group)], "__fewer")
    return t.select(group, "n", (F.col("__least") + F.col("__more") - F.col("__fewer")).alias("quota"))


def stable_sample(df: DataFrame, group: str, key: str, quota: DataFrame) -> DataFrame:
    """The ``quota`` rows of each group that come first by a hash of their key: the same on every run. The largest
    quota bounds what each task keeps of a group before it is sorted whole."""
    most = quota.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), F.col(key))
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= int(most)).join(quota.select(group, "quota"), group).filter(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")
