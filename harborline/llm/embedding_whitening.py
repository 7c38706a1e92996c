"""Whitening of embeddings by a tall and skinny QR decomposition.

Entries become whole numbers, so their sums are exact. With these sums the rows of each partition are centred
and decomposed block by block into one triangular factor; factors merge in a tree of Spark groups, and the
singular values and right vectors of the last one give the components. A covariance is never formed on the way
to them, so small eigenvalues keep their digits. The covariance of the result is measured on the data.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import discard, prepare, stored
from harborline.llm.registry import query
from harborline.llm.vectors import finite_rows, floors, width_of

SCALE, SHIFT = 1024, 100_000
#: Bytes of factors that one merging task holds; at least 2 and at most 16 factors.
MERGE = 64 << 20


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums by dimension, components in rows, their eigenvalues, all eigenvalues' sum."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    small: bool  # n * x fits 64 bits

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]


def _whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    kept, values = finite_rows(column, width)
    return kept, floors(values, SCALE) + SHIFT


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """x - S/n, from the exact n*x - S where that fits."""
    if fit.small:
        return (x * fit.n - np.array(fit.sums, np.int64)) / fit.n
    return x - np.array([s / fit.n for s in fit.sums])


def _sums(vectors: DataFrame, column: str, width: int) -> tuple[int, list[int], int]:
    """How many vectors there are, their exact sums by dimension, and the largest absolute value: a row for each
    partition and dimension, added up by Spark."""

    def run(batches):
        total, n, most = np.zeros(width, np.int64), 0, 0
        for b in batches:
            _, x = _whole(b.column(0), width)
            total, n, most = total + x.sum(0), n + len(x), max(most, int(np.abs(x).max(initial=0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(np.full(width, n)), pa.array(np.full(width, most))], names=["dim", "total", "n", "most"])

    parts = vectors.select(column).mapInArrow(run, "dim long, total long, n long, most long")
    rows = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("dim").collect()  # a row a dimension
    return (rows[0]["n"], [int(r["total"]) for r in rows], rows[0]["most"]) if rows else (0, [], 0)


def _triangle(above: np.ndarray | None, rows: np.ndarray, width: int) -> np.ndarray:
    """R of the rows below what is known of earlier ones, filled up to a square."""
    r = np.linalg.qr(rows if above is None else np.vstack((above, rows)), mode="r")
    return r if len(r) == width else np.vstack((r, np.zeros((width - len(r), width))))


def _factor(vectors: DataFrame, column: str, width: int, fit: Whitening) -> np.ndarray:
    """R of all centred rows: one factor a partition, merged ``fan`` at a time until one is left."""

    def local(batches):
        from pyspark import TaskContext

        r = None
        for b in batches:
            _, x = _whole(b.column(0), width)
            if len(x):
                r = _triangle(r, _centred(x, fit), width)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merge(key, table):
        r = None
        for i in np.argsort(table["part"].to_numpy()):  # always in one order
            r = _triangle(r, np.asarray(table["r"][int(i)].values).reshape(width, width), width)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    fan = max(2, min(16, MERGE // (8 * width * width)))
    first = stored(vectors.select(column).mapInArrow(local, "part int, r array<double>"), "factors")
    left, rs = first.agg(F.max("part")).first()[0], first
    while left > 0:
        rs, left = rs.withColumn("next", F.floor(F.col("part") / fan).cast("int")).groupBy("next").applyInArrow(merge, "part int, r array<double>"), left // fan
    r = np.array(rs.first()["r"]).reshape(width, width)
    discard(first)
    return r


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """The leading ``components`` of all vectors, as many as there are dimensions at most; None without vectors.

    Null vectors and those with null or non-finite entries are left out; shorter vectors count as ending in zeros.
    An entry c counts as floor(1024*c) + 100000, held within 2**40. Repeated rows count as often as they occur.
    A component without spread has the eigenvalue 0.
    """
    prepare(vectors.sparkSession)
    width = width_of(vectors, column)
    n, sums, most = _sums(vectors, column, width) if width else (0, [], 0)
    if not n:
        return None
    start = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0, n * most < 1 << 61)
    _, s, right = np.linalg.svd(_factor(vectors, column, width, start))
    s = np.where(s > s[0] * 1e-14, s, 0.0)
    k = min(components, width)
    return Whitening(n, sums, right[:k], s[:k] ** 2 / n, float((s**2).sum() / n), start.small)


def _projected(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """Whitened rows; a component without spread gives NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(fit.eigenvalues > 0, _centred(x, fit) @ fit.components.T / np.sqrt(fit.eigenvalues), np.nan)


def _deviations(x: np.ndarray, fit: Whitening) -> pa.Array:
    """Exact sums of (n*x - S)**2, null beyond 38 digits."""
    if fit.small:
        d = x * fit.n - np.array(fit.sums, np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 1 << 63:
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    d = x.astype(object) * fit.n - np.array(fit.sums, object)
    return pa.array([int(v) if v < 10**38 else None for v in (d * d).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, fit: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(``key``, deviation decimal(38,0), whitened array<double>) of each vector that ``fit_whitening`` would count.

    Rows with a null key stay. ``whitened`` holds null for components without spread. ``deviation`` is the exact
    sum over the dimensions of (n*x - S)**2, null beyond 38 digits. Other columns are left out.
    """
    width = len(fit.sums)

    def run(batches):
        for b in batches:
            kept, x = _whole(b.column(1), width)
            w = pa.array(_projected(x, fit).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * len(fit.eigenvalues), pa.int32()), w)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), _deviations(x, fit), lists], names=["key", "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, column).mapInArrow(run, f"key {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, fit: Whitening, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that
    have spread; products are added up by partition, then by Spark. None without such components."""
    width, live = len(fit.sums), np.flatnonzero(fit.eigenvalues > 0)
    k = len(live)

    def run(batches):
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _projected(_whole(b.column(0), width)[1], fit)[:, live]
            one, two = one + w.sum(0), two + w.T @ w
        at = np.arange(k * (k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array(np.concatenate((two.ravel(), one)))], names=["i", "j", "v"])

    if not k:
        return None
    rows = vectors.select(column).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    found = np.zeros((k + 1, k))
    for r in rows:
        found[r["i"], r["j"]] = r["v"] / fit.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = fit_whitening(vectors)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whiten(vectors, fit).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e).cast("double") for e in fit.explained])[F.col("at")].alias("explained"), F.lit(identity_error(vectors, fit)).cast("double").alias("identity_error"),
    )
