"""Totals, quantiles and truncated totals for every context limit, from one histogram of encoded lengths."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import documents, stored
from harborline.llm.registry import query
from harborline.llm.tokens import encoder

#: Lengths of a block that share one running total.
BLOCK = 256


def _count(vocabulary: str | None):
    def run(batches):
        lengths, seen = encoder(vocabulary).lengths, {}
        for b in batches:
            for length, n in zip(*(x.tolist() for x in np.unique(lengths(b.column("text")), return_counts=True))):
                seen[length] = seen.get(length, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["length", "docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(length, docs): how many documents encode to each number of tokens (null or empty: 0).

    Each task counts its own documents, so no more than a row per length and task is shuffled. Equal
    documents count as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    counts = docs.select("text").mapInArrow(_count(vocabulary), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))
    return stored(counts, "histogram")


def context_limits(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, as a context limit.

    docs_total and tokens_total are those of the corpus; docs_over counts documents longer than the limit;
    tokens_within sums the lengths up to the limit; truncated_total is what stays if every document is cut
    at the limit; quantile is the share of documents no longer than it. Limits between two lengths follow
    from the lower one: truncated_total grows by docs_over for each further token. Suffix sums are taken
    within blocks of lengths and then over blocks, so no task needs all lengths.
    """
    h = histogram.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    later = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("upper")).agg(F.sum("docs").alias("u_docs"), F.sum("tokens").alias("u_tokens"))
    far = Window.orderBy(F.col("upper").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    later = later.select("upper", F.coalesce(F.sum("u_docs").over(far), F.lit(0)).alias("u_docs"), F.coalesce(F.sum("u_tokens").over(far), F.lit(0)).alias("u_tokens"), F.sum("u_docs").over(whole).alias("docs_total"), F.sum("u_tokens").over(whole).alias("tokens_total"))
    mid = Window.partitionBy("upper").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = (
        blocks.withColumn("upper", F.floor(F.col("block") / BLOCK))
        .withColumns({"b_docs": F.coalesce(F.sum("docs").over(mid), F.lit(0)), "b_tokens": F.coalesce(F.sum("tokens").over(mid), F.lit(0))})
        .join(later, "upper")
        .select("block", (F.col("b_docs") + F.col("u_docs")).alias("b_docs"), (F.col("b_tokens") + F.col("u_tokens")).alias("b_tokens"), "docs_total", "tokens_total")
    )
    near = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = h.withColumns({"s_docs": F.coalesce(F.sum("docs").over(near), F.lit(0)), "s_tokens": F.coalesce(F.sum("tokens").over(near), F.lit(0))}).join(after, "block")
    docs_over, tokens_over = F.col("s_docs") + F.col("b_docs"), F.col("s_tokens") + F.col("b_tokens")
    return over.select(
        F.col("length").alias("context_limit"), "docs", "docs_total", "tokens_total", docs_over.alias("docs_over"),
        (F.col("tokens_total") - tokens_over).alias("tokens_within"),
        (F.col("tokens_total") - tokens_over + docs_over * F.col("length")).alias("truncated_total"),
        ((F.col("docs_total") - docs_over) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, tokens_within, truncated_total) for any given limits, in one pass over the
    histogram; an empty histogram gives zeros."""
    n, docs = F.col("length"), F.col("docs")

    def answer(k: int) -> F.Column:
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        return F.struct(F.lit(k).cast("long").alias("context_limit"), total(F.when(n > k, docs)).alias("docs_over"), total(F.when(n <= k, n * docs)).alias("tokens_within"), total(F.least(n, F.lit(k)) * docs).alias("truncated_total"))

    return histogram.agg(F.array(*map(answer, limits)).alias("a")).select(F.inline("a"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): of the table of ``context_limits``, the least length that at least such a share of the
    documents doesn't exceed (none without documents)."""
    least = lambda q: F.struct(F.lit(q).cast("double").alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("context_limit"))).alias("length"))
    return limits.agg(F.array(*map(least, shares)).alias("a")).select(F.inline("a"))


@query("op6_length_histogram")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(documents(spark, sf_dir)))
