"""Boilerplate of sources: lines and ends of descriptions by a table of rules, and ends that are learnt from the texts.

An end is learnt where descriptions of one source share their last lines behind different lines, so copies of one
description, which share all of it, teach nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.sections import words_key
from harborline.functions.text import let

LEAST = 3  # different lines in front of an end, so that it counts as the source's


def _lines(c: Column) -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")


def by_rules(df: DataFrame, key: str, source: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, source, text) without what ``rules`` (source, kind, phrase) name: ``line`` drops each line that holds the phrase's
    words, ``tail`` also all lines behind the first such line. Rules of a null source hold for every source."""
    phrase = F.concat(F.lit(" "), words_key(F.col("phrase")), F.lit(" "))
    own = rules.filter("source IS NOT NULL").groupBy(F.col("source").alias("_source")).agg(F.collect_set(F.struct("kind", phrase.alias("phrase"))).alias("_own"))
    common = rules.filter("source IS NULL").agg(F.collect_set(F.struct("kind", phrase.alias("phrase"))).alias("_common"))
    rows = df.select(key, source, text).join(own, F.col(source) == F.col("_source"), "left").join(F.broadcast(common))  # one row
    every = F.concat(F.coalesce("_own", F.array().cast("array<struct<kind:string,phrase:string>>")), "_common")
    words = lambda line: F.concat(F.lit(" "), words_key(line), F.lit(" "))
    kinds = lambda line: let(words(line), lambda w: F.transform(F.filter("_rules", lambda r: F.contains(w, r["phrase"])), lambda r: r["kind"]))
    rows = rows.withColumn("_rules", every).withColumn("_lines", F.transform(_lines(F.col(text)), lambda x: F.struct(x.alias("line"), kinds(x).alias("kinds"))))
    end = F.array_position(F.transform("_lines", lambda x: F.array_contains(x["kinds"], "tail")), True)
    left = F.filter(F.when(end > 0, F.slice("_lines", 1, (end - 1).cast("int"))).otherwise(F.col("_lines")), lambda x: F.size(x["kinds"]) == 0)
    return rows.select(key, source, F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias(text))


def _ends(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, lines, hash, before): each proper end of a text by its number of lines, the hash of its words, which is
    chained from the last line on, and the hash of the line in front of it."""
    hashed = F.transform(F.reverse(_lines(F.col(text))), lambda x: F.md5(words_key(x)))
    chain = F.aggregate(
        "h",
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda acc, x: let(F.md5(F.concat(acc["last"], x)), lambda y: F.struct(y.alias("last"), F.array_append(acc["all"], y).alias("all"))),
        lambda acc: acc["all"],
    )
    rows = df.select(key, source, hashed.alias("h")).filter(F.size("h") > 1)
    pairs = F.arrays_zip(chain.alias("hash"), F.slice("h", 2, F.size("h") - 1).alias("before"))
    return rows.select(key, source, F.posexplode(pairs).alias("i", "p")).filter("p.before IS NOT NULL").select(key, source, (F.col("i") + 1).alias("lines"), "p.hash", "p.before")


def learnt_ends(df: DataFrame, key: str, source: str, text: str, least: int = LEAST) -> DataFrame:
    """(source, hash, n): ends that stand behind ``least`` or more different lines in texts of one source. Null sources are one
    source; the rows of an end are counted in part before they are shuffled, so a common end is no hot group."""
    once = _ends(df, key, source, text).groupBy(source, "hash", "before").count()
    return once.groupBy(source, "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def without_ends(df: DataFrame, key: str, source: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, source, text, cut): each text without the longest learnt end of its source, and how many lines that were.

    ``key`` must be unique. Null and blank texts become empty; a text is never cut down to nothing."""
    learnt = learnt_ends(df, key, source, text, least).select(F.col(source).alias("_source"), F.col("hash").alias("_hash"))
    hits = _ends(df, key, source, text).join(learnt, (F.col("hash") == F.col("_hash")) & F.col(source).eqNullSafe(F.col("_source")), "left_semi")
    longest = hits.groupBy(F.col(key).alias("_key")).agg(F.max("lines").alias("_cut"))
    rows = df.select(key, source, text).join(longest, F.col(key) == F.col("_key"), "left").withColumn("cut", F.coalesce("_cut", F.lit(0)))
    lines = _lines(F.col(text))
    return rows.select(key, source, F.array_join(let(lines, lambda x: F.slice(x, F.lit(1), F.size(x) - F.col("cut"))), "\n").alias(text), "cut")
