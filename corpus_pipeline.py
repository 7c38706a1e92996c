"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.best_fit_packing import pack
from harborline.llm.common import documents, prepare, stored
from harborline.llm.jaccard_join import near_duplicates
from harborline.llm.quality_rules import passing
from harborline.llm.secret_scans import redact
from harborline.llm.template_decontamination import without_leaks


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts go; equal rows stay or go together; an empty
    table gives no rows; all columns stay, whatever their names."""
    prepare(spark)
    return passing(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without an id or without words stay, as they link with nothing. Of several rows with that id all stay
    whose texts differ, and one of those that are equal in every column.
    """
    prepare(spark)
    first = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    twice = kept.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).distinct()).unionByName(docs.filter("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; rows with one id go together; an empty table or
    benchmark takes nothing away; all columns stay."""
    prepare(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text. Null and empty texts stay as they
    are; equal rows stay equal; an empty table gives no rows; all columns stay."""
    prepare(spark)
    hidden = redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and offset. A null or empty text is one end id; repeated rows are
    packed as often as they occur; an empty table gives no rows."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Perplexities, entropies and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
