"""Vectors as short codes: a codebook for each part of a vector, found by Lloyd's rounds with filtering.

Entries are whole numbers, so sums, distances and ties are exact. Every partition cuts its vectors into parts and
builds a kd-tree over a block's parts at each position; sums and counts of all nodes come from running sums in
tree order. The candidates for a node are the codebook entries that may be nearest to a point of its bounding box:
an entry is left out where the candidate nearest to the box's middle is nearer to every corner. A node with one
candidate is assigned as a whole. Each round adds up sums and counts by part and entry in Spark; the driver
holds codebooks only.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harborline.llm.common import prepare, stored
from harborline.llm.registry import query
from harborline.llm.vectors import finite_rows, floors, width_of


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    parts: int = 16
    entries: int = 64  # 256 at most: two hexadecimal digits
    rounds: int = 2
    #: Components are held within this bound, so that a vector's error fits 64 bits.
    bound: int = 1 << 26
    #: A leaf has at most so many points (or points that are all equal).
    leaf: int = 16
    #: Bytes of the vectors that one tree spans.
    block: int = 32 << 20


#: Numbers in one work array.
CHUNK = 1 << 20


def _blocks(batches, width: int, s: Settings):
    """(rows, whole numbers) of up to ``block`` bytes of kept vectors, the vectors in the last column."""
    limit, held, size = max(1, s.block // (8 * max(1, width))), [], 0
    for b in batches:
        kept, values = finite_rows(b.column(b.num_columns - 1), width)
        held.append((pa.table(b).take(pa.array(kept)), floors(values, s.scale, s.bound)))
        size += len(kept)
        if size >= limit:
            yield pa.concat_tables(x for x, _ in held), np.concatenate([x for _, x in held])
            held, size = [], 0
    if size:
        yield pa.concat_tables(x for x, _ in held), np.concatenate([x for _, x in held])


class Tree:
    """A kd-tree over whole-number points: by level, where nodes begin and end in ``order``, their boxes, and the
    place of their first child in the next level (-1: a leaf). Boxes are halved along their longest side."""

    def __init__(self, points: np.ndarray, leaf: int):
        order, self.levels = np.arange(len(points)), []
        start, end = np.array([0]), np.array([len(points)])
        while len(start):
            sizes = end - start
            base = np.cumsum(sizes) - sizes
            node = np.repeat(np.arange(len(start)), sizes)
            at = np.arange(len(node)) + (start - base)[node]
            x = points[order[at]]
            low, high = np.minimum.reduceat(x, base), np.maximum.reduceat(x, base)
            split = (sizes > leaf) & (high > low).any(1)
            child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
            self.levels.append((start, end, low, high, child))
            axis = (high - low).argmax(1)
            middle = ((low + high) >> 1)[np.arange(len(axis)), axis]
            right = split[node] & (x[np.arange(len(x)), axis[node]] > middle[node])
            rights = np.cumsum(right) - right  # before each point, counted in its node below
            rights -= rights[base][node]
            lefts = np.arange(len(node)) - base[node] - rights
            n_left = sizes - np.add.reduceat(right.astype(np.int64), base)
            order[start[node] + np.where(right, n_left[node] + rights, lefts)] = order[at]
            cut = start + n_left
            start, end = np.stack((start, cut), 1)[split].ravel(), np.stack((cut, end), 1)[split].ravel()
        self.order, self.points = order, points[order]
        self.sums = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, 0)))


def _candidates(low: np.ndarray, high: np.ndarray, alive: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which of the alive entries may be nearest to a point of each box; of equal ones the first stays."""
    out, step = np.empty_like(alive), max(1, CHUNK // book.size)
    for at in range(0, len(low), step):
        a, z, live = low[at : at + step, None], high[at : at + step, None], alive[at : at + step]
        to_middle = ((2 * book - (a + z)) ** 2).sum(2)
        near = np.where(live, to_middle, np.iinfo(np.int64).max).argmin(1)
        best = book[near][:, None]
        corner = np.where(book > best, z, a)  # the box's corner that favours an entry most
        gap = ((book - corner) ** 2 - (best - corner) ** 2).sum(2)
        out[at : at + step] = live & ((gap < 0) | (gap == 0) & (np.arange(len(book)) <= near[:, None]))
    return out


def assign(points: np.ndarray, book: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties: the first), and sums and counts by entry."""
    tree = Tree(points, leaf)
    label, sums, counts = np.zeros(len(points), np.int64), np.zeros_like(book), np.zeros(len(book), np.int64)
    nodes, alive = np.array([0]), np.ones((1, len(book)), bool)
    for start, end, low, high, child in tree.levels:
        alive = _candidates(low[nodes], high[nodes], alive, book)
        done = alive.sum(1) == 1
        whole, entry = nodes[done], alive[done].argmax(1)
        np.add.at(sums, entry, tree.sums[end[whole]] - tree.sums[start[whole]])
        np.add.at(counts, entry, end[whole] - start[whole])
        for a, z, e in zip(start[whole].tolist(), end[whole].tolist(), entry.tolist()):
            label[a:z] = e
        leaves = ~done & (child[nodes] < 0)
        _single(tree, start[nodes[leaves]], end[nodes[leaves]], alive[leaves], book, label, sums, counts)
        deeper = ~done & (child[nodes] >= 0)
        nodes = (child[nodes[deeper]][:, None] + np.arange(2)).ravel()
        alive = np.repeat(alive[deeper], 2, 0)
        if not len(nodes):
            break
    out = np.empty_like(label)
    out[tree.order] = label
    return out, sums, counts


def _single(tree: Tree, start, end, alive, book, label, sums, counts) -> None:
    """Points of leaves with several candidates, one by one."""
    sizes = end - start
    node = np.repeat(np.arange(len(start)), sizes)
    at = np.arange(len(node)) - (np.cumsum(sizes) - sizes)[node] + start[node]
    step = max(1, CHUNK // book.size)
    for i in range(0, len(at), step):
        some = at[i : i + step]
        far = ((tree.points[some, None] - book) ** 2).sum(2)
        label[some] = np.where(alive[node[i : i + step]], far, np.iinfo(np.int64).max).argmin(1)
    np.add.at(sums, label[at], tree.points[at])
    counts += np.bincount(label[at], minlength=len(book))


def _first(vectors: DataFrame, key: str, column: str, width: int, s: Settings) -> np.ndarray:
    """The vectors with the smallest keys, in order; of several with one key the smallest. Each partition hands on
    no more than ``entries`` rows."""

    def run(batches):
        best: dict = {}
        for rest, x in _blocks(batches, width, s):
            for k, v in zip(rest.column(0).to_pylist(), x):
                if k is not None and (k in best or len(best) < s.entries or k < top):
                    best[k] = min(best[k], tuple(v.tolist())) if k in best else tuple(v.tolist())
                    if len(best) > s.entries:
                        del best[top]
                    top = max(best)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), kind), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["key", "x"])

    kind = to_arrow_type(vectors.schema[key].dataType)
    rows = vectors.select(key, column).mapInArrow(run, f"key {vectors.schema[key].dataType.simpleString()}, x array<long>")
    return np.array([r["x"] for r in rows.groupBy("key").agg(F.min("x").alias("x")).orderBy("key").limit(s.entries).collect()], np.int64)


def _books(first: np.ndarray, s: Settings) -> np.ndarray:
    """Codebooks by part, entry and position."""
    return first.reshape(len(first), s.parts, -1).transpose(1, 0, 2)


def _round(vectors: DataFrame, column: str, books: np.ndarray, s: Settings) -> np.ndarray:
    """The codebooks after one more round; entries without a part stay."""
    parts, k, w = books.shape

    def run(batches):
        sums, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
        for _, x in _blocks(batches, parts * w, s):
            for p in range(parts):
                _, more, n = assign(np.ascontiguousarray(x[:, p * w : (p + 1) * w]), books[p], s.leaf)
                sums[p] += more
                counts[p] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), *(pa.array(sums[part, entry, i]) for i in range(w))], names=["part", "entry", "n", *(f"s{i}" for i in range(w))])

    names = ["n", *(f"s{i}" for i in range(w))]
    rows = vectors.select(column).mapInArrow(run, "part long, entry long, " + ", ".join(f"{c} long" for c in names))
    found, out = rows.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect(), books.copy()  # a row an entry
    for r in found:
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[1:]]
    return out


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """All columns but ``column`` with ``code`` (two hexadecimal digits a part) and ``error`` of each kept vector, and
    the codebooks (part, entry, position) behind them.

    Null vectors and those with null or non-finite components are left out. Shorter vectors count as ending in zeros,
    and so does every vector where the longest doesn't cut evenly. A component x counts as floor(scale*x), held within
    ``bound``. The codebooks begin with the smallest keys (null keys never; of repeated keys the smallest vector once),
    so a table with fewer keys has fewer entries, and one without keys or vectors gives no rows. Repeated rows
    count as often as they occur. Columns named code or error are replaced.
    """
    s = settings
    if not 1 <= s.entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hexadecimal digits a part")
    prepare(vectors.sparkSession)
    width = -(-width_of(vectors, column) // s.parts) * s.parts
    first = _first(vectors, key, column, width, s)
    others = [c for c in vectors.columns if c not in (column, "code", "error")]
    rest = vectors.select(*others, column)
    fields = "".join(f"`{c}` {rest.schema[c].dataType.simpleString()}, " for c in others)
    if not width or not len(first):
        return vectors.sparkSession.createDataFrame([], f"{fields}code string, error long"), np.zeros((s.parts, 0, 0), np.int64)
    books = _books(first, s)
    for _ in range(s.rounds):
        books = _round(vectors, column, books, s)
    w = books.shape[2]

    def run(batches):
        for kept, x in _blocks(batches, width, s):
            code, error = np.empty((len(x), s.parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(s.parts):
                points = np.ascontiguousarray(x[:, p * w : (p + 1) * w])
                label, _, _ = assign(points, books[p], s.leaf)
                code[:, p] = label
                error += ((points - books[p][label]) ** 2).sum(1)
            made = pa.table([*kept.columns[:-1], pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=[*others, "code", "error"])
            yield from made.to_batches(max_chunksize=10_000)

    return rest.mapInArrow(run, f"{fields}code string, error long"), books


SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, CAST(p AS INT) AS p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, range(16) AS t(p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64
), b0 AS (
  SELECT p, entry, x FROM parts JOIN first USING (vec_id)
), {rounds}
a{n} AS ({assign}), found AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{n} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{n}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM found JOIN kept USING (vec_id), books
"""
_ASSIGN = """
  SELECT q.vec_id, q.p, min({{'d': list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))), 'e': b.entry}}) AS best
  FROM parts q JOIN b{n} b USING (p) GROUP BY q.vec_id, q.p
"""
_ROUND = """
a{n} AS ({assign}), m{n} AS (
  SELECT p, e AS entry, list(y ORDER BY i) AS y FROM (
    SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{n} JOIN parts USING (vec_id, p), range(1, len(x) + 1) AS t(i) GROUP BY p, best.e, i
  ) GROUP BY p, e
), b{m} AS (
  SELECT b.p, b.entry, coalesce(y, x) AS x FROM b{n} b LEFT JOIN m{n} USING (p, entry)
),"""


def _sql(rounds: int) -> str:
    return SQL.format(rounds="".join(_ROUND.format(n=i, m=i + 1, assign=_ASSIGN.format(n=i)) for i in range(rounds)), n=rounds, assign=_ASSIGN.format(n=rounds))


@query("op12_vector_codes", _sql(Settings.rounds))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    kept = stored(codes, "codes")
    sums = kept.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return kept.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
