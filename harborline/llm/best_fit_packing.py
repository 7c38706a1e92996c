"""Packing of documents into fixed-length sequences by exact complements.

Only the number of pieces of each length matters for the plan, and there are no more lengths than tokens
in a sequence. So the plan is made from the histogram alone, with single, pair and triple length sums as
the index of exact complements; the pieces themselves stay distributed. Each piece is numbered among the
pieces of its length, and its number falls into one of the plan's runs, which gives sequence and offset.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import documents, stored
from harborline.llm.registry import query
from harborline.llm.tokens import END_ID, encoder

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def _complement(gap: int, left: np.ndarray, pairs: dict[int, list[tuple[int, int]]], most: int) -> tuple[int, ...] | None:
    """Up to ``most`` (of three) available lengths that sum to ``gap`` exactly, larger pieces first."""

    def there(*lengths: int) -> bool:
        return all(left[x] >= lengths.count(x) for x in lengths)

    if most and left[gap]:
        return (gap,)
    for x, y in pairs.get(gap, ()) if most > 1 else ():
        if there(x, y):
            return (x, y)
    for x in np.flatnonzero(left[:gap])[::-1].tolist() if most > 2 else ():
        for y, z in pairs.get(gap - x, ()):
            if y <= x and there(x, y, z):
                return (x, y, z)
    return None


def _filled(left: np.ndarray, pairs: dict[int, list[tuple[int, int]]], most: int, residues: bool) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that up to ``most`` exact complements fill, longest lengths first; uses up ``left``.

    With ``residues`` a length without an exact complement stays for later; else its gap takes the longest
    length that fits, and what then remains is looked at in the same way.
    """
    capacity, out = len(left) - 1, []
    for longest in np.flatnonzero(left)[::-1].tolist():
        while left[longest]:
            left[longest] -= 1
            took, gap = [longest], capacity - longest
            while gap > 0:
                more = _complement(gap, left, pairs, most)
                if more is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    if residues or not len(fits):
                        break
                    more = (int(fits[-1]),)
                for x in more:
                    left[x] -= 1
                took += more
                gap -= sum(more)
            if gap and residues:
                left[longest] += 1
                break
            times = 1 + min(int(left[x]) // took.count(x) for x in set(took))
            for x in took:
                left[x] -= times - 1
            out.append((tuple(took), times))
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: pieces, longest first, go where the smallest gap is that holds them.

    Sequences with the same lengths are one entry, so the work grows with the lengths, not with the pieces.
    """
    capacity = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        while n:
            gap = min((g for g in open_ if g >= x), default=capacity)
            lengths, many = open_[gap].pop() if gap in open_ else ((), n)
            if gap in open_ and not open_[gap]:
                del open_[gap]
            each = gap // x
            full = min(many, n // each)
            some = n % each if full < many else 0  # the last sequence may take fewer
            n -= full * each + some
            untouched = many - full - (some > 0)
            for k, times in ((each, full), (some, 1 if some else 0), (0, untouched if lengths else 0)):
                if times:
                    open_.setdefault(gap - k * x, []).append((lengths + (x,) * k, times))
    return [entry for entries in open_.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up ``counts`` (pieces by length).

    Combinations that fill a gap exactly are consumed, then best fit places the residues. Complements of
    three lengths may use up short pieces that later gaps need, so this is done with up to three, two, one
    and no complements, and once with gaps that are refilled after the longest length that fits. The
    plan with the fewest sequences counts, so it is never longer than that of best-fit decreasing alone.
    """
    given = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        given[length] += n
    pairs: dict[int, list[tuple[int, int]]] = {}
    there = np.flatnonzero(given).tolist()
    for x in reversed(there):
        for y in there:
            if y > x or x + y > capacity:
                break
            pairs.setdefault(x + y, []).append((x, y))
    least = -(-sum(x * int(given[x]) for x in there) // capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for most, residues in ((3, True), (3, False), (2, True), (1, True), (0, True)):
        left = given.copy()
        made = _filled(left, pairs, most, residues)
        made += best_fit(left)
        if best is None or sum(n for _, n in made) < sum(n for _, n in best):
            best = made
        if sum(n for _, n in best) == least:  # nothing can be shorter
            break
    return best


def _cut(vocabulary: str | None, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, offs = encode(b.column("text"), END_ID)
            n = np.diff(offs)
            times = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), times)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            end = ((n - 1) % capacity + 1)[doc] + piece * capacity
            length = np.where(piece == 0, end, capacity)
            start = end - length
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - (np.cumsum(many) - many)[length[order]]
            place += seen[length]
            seen += many
            at = (offs[doc] + start).tolist()
            crc = [zlib.crc32(ids[x : x + k]) for x, k in zip(at, length.tolist())]
            values = (piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(doc), part, np.int32), place)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), *map(pa.array, values)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    A null or empty text is its end id alone. Only documents of more than ``capacity`` tokens are cut;
    their first piece is what the full ones leave. Equal documents and equal ids are packed as often as
    they occur; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, capacity), PIECES), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: from which number, first sequence, pieces in each sequence, offset
    used, first = dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, capacity):
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((used[x], first, at))
            used[x] += times
            at += x
        first += times
    flat = [(x, i, *r, nxt) for x, rs in runs.items() for i, (r, nxt) in enumerate(zip(rs, [*(r[0] for r in rs[1:]), used[x]]))]
    table = spark.createDataFrame(flat, "length long, run int, low long, first long, offset long, high long")
    numbered = pieces.join(base, ["length", "part"]).withColumn("number", F.col("base") + F.col("place"))
    placed = numbered.join(F.broadcast(table), (numbered["length"] == table["length"]) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).drop(table["length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
