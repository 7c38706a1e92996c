"""Declarative merge of new rows into old ones: a full outer join with one rule a column."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


RULES = {
    "replace": lambda old, new: new,
    "keep_old": lambda old, new: F.coalesce(old, new),
    "keep_if_null": lambda old, new: F.coalesce(new, old),
    "keep_if_blank": lambda old, new: F.when(_blank(new), old).otherwise(new),
    "increment": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "greatest": F.greatest,
    "least": F.least,
}


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """``old`` with the rows of ``new``: rows of one side stay as they are; where both have a key, each
    column follows its rule in ``RULES``. Keys are unique on each side."""
    o = old.select(F.col(key), F.struct(*rules).alias("o"))
    n = new.select(F.col(key), F.struct(*rules).alias("n"))
    both = o.join(n, key, "full_outer")
    return both.select(key, *(F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(RULES[rule](F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c, rule in rules.items()))
