"""Token ids of documents in Parquet files that allow selective reads.

Documents are sorted by id over range partitions and encoded in place; Spark writes one file a partition,
with ids as ``array<int>``. Row groups and pages are small, ids and offsets are dictionary or delta
encoded, and the writer's column and page indexes let a reader fetch the rows of some documents, or the
metadata columns alone, without touching the other pages.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import documents, input_bytes, new_path
from harborline.llm.registry import query
from harborline.llm.tokens import END_ID, encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Sizes in bytes: small enough that a page holds a few dozen documents.
ROW_GROUP, PAGE, DICTIONARY_PAGE = 16 << 20, 256 << 10, 1 << 20
#: Rows after which the writer looks at the size of a page or row group for the first time.
CHECK = 16
#: Bytes of input for each file.
FILE = 128 << 20


def _encode(vocabulary: str | None):
    def run(batches):
        from pyspark import TaskContext

        encode, at = encoder(vocabulary).encode, 0
        part = TaskContext.get().partitionId()
        for b in batches:
            ids, offs = encode(b.column("text"), END_ID)
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(b), part, np.int32)), pa.array(at + offs[:-1]), pa.array(np.diff(offs)), lists], names=[c.split()[0] for c in SCHEMA.split(", ")])
            at += len(ids)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text; other columns are left out) and write the ids below ``path``.

    There is a file for each ``FILE`` bytes of the input, or ``partitions`` files, at least one a shuffle
    partition. A null or empty text has the end id alone. Rows with a null doc_id come first; rows with one
    id lie beside each other in the order of a hash of their texts, so many of them can share several files.
    An empty table writes files without rows. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(source) // FILE))
    ordered = source.withColumn("__tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    writer = ordered.mapInArrow(_encode(vocabulary), SCHEMA).write
    for key, value in {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.dictionary.page.size": DICTIONARY_PAGE, "parquet.page.size.row.check.min": CHECK, "parquet.block.size.row.check.min": CHECK, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "compression": "zstd"}.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before, in ascending order.

    The offsets of the files come from one small row each, so a query that needs metadata only reads no ids.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["n"]
    starts = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            values = np.asarray(ids.values).astype("<i4", copy=False)
            cuts = np.asarray(ids.offsets).tolist()
            crc = [zlib.crc32(values[a:z]) for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return with_crc32(read_token_files(spark, path))
