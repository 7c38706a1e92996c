"""Shared helpers: the documents table, tables written in the shared folder, and Arrow columns."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks hold, and drop shuffle files once a query has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(6 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary
    one, which only a local master's tasks can read."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='harborline-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Options of tables with large rows: row groups of 8 MB (compressed), as a reader may hold a whole one; else their size is looked at every 100 to 10,000 rows only.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: what follows doesn't recompute it,
    and a lost executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "_stored_as"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._stored_as}")
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crc_of_id(doc_id) -> F.Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes of ``df``; 0 where it knows nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """``batch`` in runs of rows with about ``limit`` bytes of text in ``column``; a longer text stays whole."""
    ends, at = flat_text(batch.column(column))[1], 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or if ``df`` has such a column, that with underscores."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
