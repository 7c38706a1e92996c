"""Quality scores by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are hashed unigrams and bigrams of lower-cased words, and of word shapes (first and last
character, length, capitals, digits and marks inside), so that unseen words still say something. A score
is the logistic function of a sparse dot product.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import crc_of_id, documents, flat_text
from harborline.llm.hashing import U, Words, mix, prefix, spans
from harborline.llm.registry import query


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the model is fitted on (the first by a hash of the id);
    all others are as usual for follow-the-regularised-leader."""

    bits: int = 18
    max_rows: int = 8000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    scale: float = 8.0


_KIND = np.full(256, 1, np.uint64)  # letters, and bytes of other alphabets
_KIND[48:58] = 2
_KIND[65:91] = 3
_MARK = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_a:_b] = 4
    _MARK[_a:_b] = True


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and where each text's begin. Every text has the constant 0."""
    raw, offs = flat_text(column)
    w = Words(raw, offs, lower=True)
    first, last, size = w.starts, w.ends - 1, np.minimum(w.ends - w.starts, 12).astype(np.uint64)
    plain = flat_text(column)[0]

    def inside(flags):
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.minimum(sums[w.ends] - sums[w.starts], 3).astype(np.uint64)

    marks = inside(_MARK[plain])
    tail = np.where(_MARK[plain[last]], plain[last], 0).astype(np.uint64) if len(last) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        shape = _KIND[plain[first]] + (size << U(3)) + (marks << U(8)) + (inside(_KIND[plain] == 2) << U(12)) + (inside(_KIND[plain] == 3) << U(16)) + (tail << U(20))
        shape = mix(shape + U(77))
        found = [(w.first, w.hashes()), (w.first, shape)]
        left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts))
        for values, seed in ((found[0][1], 1), (shape, 2)):
            p = np.flatnonzero(left >= 2)
            cuts = np.searchsorted(p, w.first)
            pairs = spans(prefix(values), p, p + 2) + U(seed)
            found.append((cuts, np.where(values[p] == values[p + 1], U(seed << 60), pairs) if seed == 1 else pairs))  # all repeated words are one bigram
        p = np.flatnonzero(left >= 3)
        found.append((np.searchsorted(p, w.first), spans(prefix(shape), p, p + 3) + U(3)))
    n = len(w.counts)
    sizes = np.ones(n, np.int64)
    for cuts, _ in found:
        sizes += np.diff(cuts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(at[-1], np.int32)
    begin = at[:-1] + 1
    for cuts, values in found:
        k = np.diff(cuts)
        to = np.arange(len(values)) - np.repeat(cuts[:-1], k) + np.repeat(begin, k)
        out[to] = 1 + (values >> U(64 - bits)).astype(np.int32)
        begin = begin + k
    return out, at


def _fit(settings: Settings):
    def run(batches):
        rows = []
        for b in batches:
            for x, y in zip(b.column("features").to_pylist(), b.column("label").to_pylist()):
                u, c = np.unique(np.frombuffer(x, "<i4"), return_counts=True)
                v = c * (settings.scale / c.sum())
                v[0] = 1.0  # the constant
                rows.append((u, v, y))
        size = (1 << settings.bits) + 1
        z, n, s = np.zeros(size), np.zeros(size), settings

        def weights(i):
            w = -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
            return np.where(np.abs(z[i]) <= s.l1, 0.0, w)

        for _ in range(s.epochs):
            for i, v, y in rows:
                w = weights(i)
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
                g = (p - y) * v
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w
                n[i] += g * g
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights(np.arange(size)).astype("<f4").tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights by feature number, from at most ``max_rows`` rows of ``labels`` (doc_id, label) joined to ``docs``.

    Rows with a null id or label are left out; a document with several labels counts with each; without
    any labelled document all weights are 0 and every score is one half.
    """
    order = F.xxhash64("doc_id")
    chosen = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").orderBy(order, "doc_id", "label").limit(settings.max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def build(batches):
        for b in batches:
            f, at = features(b.column("text"), settings.bits)
            raw = [f[a:z].astype("<i4").tobytes() for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(raw, pa.binary())], names=["doc_id", "label", "features"])

    rows = texts.mapInArrow(build, "doc_id long, label int, features binary").repartition(1).sortWithinPartitions(order, "doc_id", "label")
    row = rows.mapInArrow(_fit(settings), "weights binary").first()
    return np.frombuffer(row["weights"], "<f4") if row else np.zeros((1 << settings.bits) + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every row; a null or empty text has the constant's score."""
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))

    def run(batches):
        w = sent.value
        for b in batches:
            f, at = features(b.column("text"), settings.bits)
            values = w[f]
            values[at[:-1]] = 0.0  # the constant counts whole
            dot = w[0] + np.add.reduceat(values, at[:-1]) * settings.scale / np.diff(at) if len(at) > 1 else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    weights = train(docs, labels.filter(crc_of_id("doc_id") % 5 != 0))
    scored = score(docs, weights)
    return scored.select("doc_id", F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
