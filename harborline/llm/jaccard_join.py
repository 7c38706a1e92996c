"""Exact self-join of documents on the Jaccard distance of their word shingles.

Nearly all documents are at distance 1 from each other, where pivots separate nothing. So the space is first
cut by projections that lose no link, and pivots and the triangle inequality work within what is left:

* Documents with one shingle set (distance 0) become one node.
* Two linked sets of n and m shingles differ in at most (n + m) / 9 of them. A window of sizes deals the
  shingles into one part more than that by a hash, so two linked sets agree on a whole part. The sets that
  agree on a part, at projected distance 0 from each other, are a region; most regions hold one set and go.
* In each region the least node is the pivot. A sketch of every set bounds distances from below, and each
  node measures exactly the nearest pivot that it may be linked to, which contracts groups of near copies.
* By the triangle inequality nodes beyond twice the radius of a pivot have no link into its Voronoi cell. So
  the cell, with the boundary nodes within twice the radius, is one region of the next round, and all
  outside the cell, boundary nodes included, the other. Regions of a single component are done.
* Regions with one least component become one where that has fewer pairs: near copies meet in hundreds of regions.
* Small regions, and large cells in blocks, compare sketches across components in one task each: first every
  node measures its nearest other, then what is still apart all pairs that the sketches allow. A
  large outer region goes into the next round, by other pivots if this one's cell took a good part of it,
  or else by a new projection, and after ``LEVELS`` rounds it is compared in blocks, too.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import discard, documents, flat_text, slices, stored
from harborline.llm.components import components
from harborline.llm.hashing import U, Words, mix, prefix, spans
from harborline.llm.registry import query

SHINGLE = 5
#: Nodes of a region that are compared in one task.
SMALL = 2048
#: Rounds after which large regions are compared in blocks.
LEVELS = 8
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
# Two sets of n and m shingles with d in one of them only link if 9 * d <= n + m (similarity 0.8), and are
# within twice that distance if 4 * d <= n + m.

# The largest size of each window of sizes, the most in which linked sets differ whose larger one is in the
# window, how many parts may be empty in a set, and the number of parts.
_tops = [4]
while _tops[-1] < 1 << 31:
    _tops.append(max(_tops[-1] + 1, _tops[-1] * 5 // 4))
TOPS = np.array(_tops)
MOST = 2 * TOPS // 9
SPARE = 2 + MOST // 8
PARTS = MOST + 1 + SPARE


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending by hash, end to end, and where each text's begin."""
    w = Words(*flat_text(column), lower=True)
    sums = prefix(w.hashes())
    at = w.positions(shingle)
    text = np.searchsorted(w.first, at, "right") - 1
    values = spans(sums, at, at + shingle)
    short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
    values = np.insert(values, np.searchsorted(text, short), spans(sums, w.first[short], w.first[short + 1]))
    begin = np.concatenate(([0], np.cumsum(np.where(w.counts < shingle, w.counts > 0, w.counts - shingle + 1))))
    cuts = begin.tolist()
    for a, z in zip(cuts, cuts[1:]):
        values[a:z].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[begin[:-1][np.diff(begin) > 0]] = True
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[begin]


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum modulo 2**64 of each text's part of ``values``."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    return sums[at[1:]] - sums[at[:-1]]


def _sliced(batches):
    return (s for b in batches for s in slices(b, "text", SLICE))


def _digests(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that stand for each set."""
    with np.errstate(over="ignore"):
        return _sum(mix(v + U(11)), at).view(np.int64), _sum(mix(v ^ U(0xABCDEF0123456789)), at).view(np.int64)


def _sets(batches, shingle: int):
    """Batches with their texts' sets; of rows with a column ``d1`` those whose sets have that digest."""
    for b in _sliced(batches):
        v, at = shingle_sets(b.column("text"), shingle)
        if "d1" in b.schema.names:
            own = _digests(v, at)[0] == b.column("d1").to_numpy()
            if not own.all():
                b = b.filter(pa.array(own))
                v, at = shingle_sets(b.column("text"), shingle)
        yield b, v, at


SIGNATURES = "doc_id long, n long, d1 long, d2 long"


def _signatures(shingle: int):
    def run(batches):
        for b, v, at in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), *map(pa.array, _digests(v, at))], names=[c.split()[0] for c in SIGNATURES.split(", ")])

    return run


def agreeing_parts(v: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): a key for each part of each text, equal where two texts agree on a part.

    A text takes part in the window of its own size and in those of the sizes that it may be linked to from
    below. Empty parts have a key only in texts with more of them than ``SPARE``: of two others, one has so
    few that they also agree on a part with shingles in it.
    """
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        place, value = mix(v + U(2 * seed + 1) * U(0x9E3779B97F4A7C15)) >> U(32), mix(v ^ U(0xC2B2AE3D27D4EB4F))
    low, high = np.searchsorted(TOPS, size), np.searchsorted(TOPS, 5 * size // 4)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for j in range(int((high - low).max(initial=0)) + 1):
        window = np.minimum(low + j, len(TOPS) - 1)
        takes = (size > 0) & (low + j <= high) & (MOST[window] > 0)
        parts = np.where(takes, PARTS[window], 0)
        base = np.cumsum(parts) - parts
        mine = takes[text]
        t = text[mine]
        slot = base[t] + ((place[mine] * parts[t].astype(U)) >> U(32)).astype(np.int64)
        total = int(parts.sum())
        content = np.zeros(total, U)
        np.add.at(content, slot, value[mine])
        empty = np.bincount(slot, minlength=total) == 0
        owner = np.repeat(np.arange(len(size)), parts)
        sparse = np.bincount(owner[empty], minlength=len(size)) > SPARE[window]
        with np.errstate(over="ignore"):
            name = mix((np.arange(total) - base[owner]).astype(U) + (window[owner].astype(U) << U(40)) + (U(seed) << U(56)))
            key = mix(content + name)
        keep = ~empty | sparse[owner]
        owners.append(owner[keep])
        keys.append(key[keep])
    return np.concatenate(owners), np.concatenate(keys)


REGIONS = "region long, node long"


def _project(shingle: int, seed: int):
    """Regions by part; with a column ``regions``, parts of those."""

    def run(batches):
        for b, v, at in _sets(batches, shingle):
            owner, key = agreeing_parts(v, at, seed)
            if "regions" in b.schema.names:
                lists = b.column("regions")
                n = np.diff(np.asarray(lists.offsets))[owner]
                begin = np.asarray(lists.offsets)[:-1][owner] - np.asarray(lists.offsets)[0]
                which = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                old = np.asarray(lists.flatten()).view(U)[which]
                owner, key = np.repeat(owner, n), mix(np.repeat(key, n) ^ mix(old))
            for lo in range(0, max(1, len(key)), 100_000):
                some = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), b.column("node").take(pa.array(owner[some]))], names=["region", "node"])

    return run


NEAR = "node long, n int, fine binary, text string"


def sketches(v: np.ndarray, at: np.ndarray, times: int) -> list[bytes]:
    """A bit for each remainder of the shingles' hashes, whether an odd number of them has it. There are at least
    ``times`` bits a shingle, and a power of two."""
    size = np.diff(at)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(times * size, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    text = np.repeat(np.arange(len(size)), size)
    odd = np.bincount(base[text] + (mix(v ^ U(0x5851F42D4C957F2D)) & (bits[text] - 1).astype(U)).astype(np.int64), minlength=int(bits.sum())) & 1
    raw, cuts = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), (base // 8).tolist()
    return [raw[a : a + n // 8] for a, n in zip(cuts, bits.tolist())]


def differ_at_least(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many shingles a set differs from each other one at least, by sketches of one size (words of 64 bits)."""
    return np.bitwise_count(sketch ^ others).sum(-1, dtype=np.int64)


def _folded(raw: bytes, words: int) -> np.ndarray:
    s = np.frombuffer(raw, "<u8")
    return np.bitwise_xor.reduce(s.reshape(-1, words), 0)


def _look(shingle: int):
    def run(batches):
        for b, v, at in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(at).astype(np.int32)), pa.array(sketches(v, at, 8), pa.binary()), b.column("text")], names=[c.split()[0] for c in NEAR.split(", ")])

    return run


def _bound(batches):
    """reach: 1 within the radius, 2 within twice the radius, 3 beyond, as far as the fine sketches tell."""
    for b in batches:
        n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
        least = []
        for x, y in zip(b.column("of_a").to_pylist(), b.column("of_b").to_pylist()):
            words = min(len(x), len(y)) // 8
            least.append(int(differ_at_least(_folded(x, words), _folded(y, words))))
        least = np.array(least, np.int64)
        reach = np.where(9 * least <= n, 1, np.where(4 * least <= n, 2, 3))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(reach.astype(np.int32)), pa.array(least)], names=["a", "b", "reach", "least"])


def _bounded(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their reach and in how many shingles they differ at least."""
    x, y = (near.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_bound, "a long, b long, reach int, least long")


def _measure(shingle: int):
    def run(batches):
        for b in (s for batch in batches for s in slices(batch, "of_a", SLICE)):
            (x, x_at), (y, y_at) = (shingle_sets(b.column(c), shingle) for c in ("of_a", "of_b"))
            keep = []
            for i in range(len(b)):
                both = np.sort(np.concatenate((x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]])))
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(near: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose documents are within the radius, by the sets of their whole texts."""
    x, y = (near.select(F.col("node").alias(c), F.col("text").alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_measure(shingle), "a long, b long")


def _compare(nearest: bool):
    """Pairs of different components in one region that the sketches allow; ``nearest``: only that with the nearest
    other of each node outside the region's largest component."""

    def run(batches):
        for b in batches:
            left, right, least = ([np.zeros(0, np.int64)] for _ in range(3))
            for v in (x.values for x in b.column("nodes")):
                node, label, n = (v.field(c).to_numpy().astype(np.int64) for c in ("node", "label", "n"))
                raw = v.field("sketch").to_pylist()
                words = min(map(len, raw)) // 8
                s = np.stack([_folded(x, words) for x in raw])
                of = np.unique(label, return_inverse=True)[1]
                emits = of != np.bincount(of).argmax() if nearest else np.ones(len(node), bool)
                for i in np.flatnonzero(emits):
                    at = np.flatnonzero(label != label[i]) if nearest else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                    d = differ_at_least(s[i], s[at])
                    met = 9 * d <= n[at] + n[i]
                    at, d = at[met], d[met]
                    if nearest and len(d):
                        at, d = at[[d.argmin()]], d[[d.argmin()]]
                    left.append(np.full(len(at), node[i]))
                    right.append(node[at])
                    least.append(d)
            a, z = np.concatenate(left), np.concatenate(right)
            if not nearest:
                a, z = np.unique(np.stack((np.minimum(a, z), np.maximum(a, z))), axis=1)
                least = [np.zeros(len(a), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), pa.array(np.concatenate(least))], names=["a", "b", "least"])

    return run


def _compared(near: DataFrame, rows: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): what regions (region, node, label, size, low), cut into blocks where they are large, have to measure."""
    rows = stored(_merged(rows), "merged")
    small = F.col("size") <= SMALL
    rows = rows.filter(small).select("region", "node", "label").union(_blocks(rows.filter(~small)))
    member = F.struct("node", "label", "n", F.col("fine").alias("sketch"))
    lists = rows.join(near.select("node", "n", "fine"), "node").groupBy("region").agg(F.collect_list(member).alias("nodes"))  # about SMALL nodes
    pairs = lists.select("nodes").mapInArrow(_compare(nearest), "a long, b long, least long")
    if nearest:
        return pairs.groupBy("a").agg(F.min_by("b", "least").alias("b"))
    return pairs.select("a", "b").distinct()


def _merged(rows: DataFrame) -> DataFrame:
    """Regions (region, node, label, size, low) with one least component ``low`` as one region, where that has no more
    pairs than they have together. Near copies agree on most of their parts, so they would meet again in as many regions."""
    union = rows.select("low", "node", "label").distinct()
    sizes = union.groupBy("low").agg(F.count("*").alias("all")).join(rows.groupBy("low").agg(F.sum("size").alias("pairs")), "low")
    one = sizes.filter("all * all <= pairs").select("low", F.col("all").alias("size"))
    merged = union.join(one, "low").select(F.xxhash64("low", F.lit("merged")).alias("region"), "node", "label", "size")
    return merged.union(rows.join(one.select("low"), "low", "left_anti").select("region", "node", "label", "size"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Large regions (region, node, label, size) as pairs of blocks, so that any two nodes meet in one."""
    blocks = F.ceil(F.col("size") * 2 / SMALL)
    own = F.pmod(F.xxhash64("node", "region"), blocks)
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    return rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "node", "label")


def _shared(rows: DataFrame) -> DataFrame:
    """Regions of more than one node, by a name that depends on their nodes alone, so that equal ones are one."""
    whole = Window.partitionBy("region")
    rows = rows.withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole), "all": F.sum(F.shiftright(F.xxhash64("node"), 20)).over(whole)})
    return rows.filter("low < high").select(F.xxhash64("low", "high", "all").alias("region"), "node").distinct()


def _labels(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return components(out)


def _open(rows: DataFrame) -> DataFrame:
    """``rows`` (region, side, node, label, boundary) of regions with several components, with their sizes, how
    many boundary nodes they have and their least component ``low``."""
    by = rows.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("boundary").alias("boundaries"))
    return rows.join(by.filter("low < high").drop("high"), "region")


def _round(near: DataFrame, regions: DataFrame, links: list[DataFrame], shingle: int, level: int):
    """One round over ``regions``: adds to ``links``; gives the next round's regions, None if there are none."""
    pivots = stored(regions.groupBy("region").agg(F.min("node").alias("pivot")), "pivots")
    pairs = regions.join(pivots, "region").filter("node <> pivot").select("node", "pivot").distinct()
    bounds = stored(_bounded(near, pairs.withColumnsRenamed({"node": "a", "pivot": "b"})), "bounds").withColumnsRenamed({"a": "node", "b": "pivot"})
    nearest = bounds.filter("reach = 1").groupBy("node").agg(F.min_by("pivot", "least").alias("pivot"))
    links.append(stored(_linked(near, nearest.select(F.col("node").alias("a"), F.col("pivot").alias("b")), shingle), "links"))

    label = stored(_labels(links), "labels").withColumnRenamed("component", "label")
    cell = links[-1].select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(0).alias("cell"))
    placed = regions.join(pivots, "region").join(bounds.join(cell, ["node", "pivot"], "left"), ["node", "pivot"], "left").join(label, "node", "left")
    zone = F.when(F.col("node") == F.col("pivot"), 0).otherwise(F.coalesce("cell", F.greatest(F.col("reach") - 1, F.lit(1))))  # 0 cell, 1 boundary, 2 beyond
    placed = placed.select("region", "node", F.coalesce("label", "node").alias("label"), zone.alias("zone"))
    sides = F.when(F.col("zone") == 0, F.array(F.lit(0))).when(F.col("zone") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    split = placed.withColumn("side", F.explode(sides)).select(F.xxhash64("region", "side", F.lit(level)).alias("region"), "side", "node", "label", (F.col("zone") == 1).cast("int").alias("boundary"))
    rows = stored(_open(stored(split, "zones")), "open-regions")
    discard(pivots)

    large = (F.col("size") > SMALL) & (F.col("side") == 1) & F.lit(level + 1 < LEVELS)
    now, rest = rows.filter(~large), rows.filter(large)
    links.append(stored(_linked(near, _compared(near, now, True), shingle), "links"))
    label = stored(_labels(links), "labels").withColumnRenamed("component", "label")
    again = now.drop("label", "size", "boundaries", "low").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    candidates = stored(_compared(near, _open(again), False), "candidates")
    links.append(stored(_linked(near, candidates, shingle), "links"))
    if rest.isEmpty():
        return None
    # where the pivot saw next to nothing near it, a new projection takes the region apart; else other pivots do
    apart = F.col("boundaries") * 8 < F.col("size")
    lists = rest.filter(apart).groupBy("node").agg(F.collect_list("region").alias("regions"))  # at most one for each part of the text
    again = _shared(near.select("node", "text").join(lists, "node").mapInArrow(_project(shingle, level + 1), REGIONS))
    return stored(rest.filter(~apart).select("region", "node").union(again), "regions")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest id reachable over links of similarity 0.8 or more, the document's own
    included. A null or text without words has no shingles and links with nothing; rows with a null id take no
    part and get a null component; rows that share an id count each by its own text; an empty table gives
    no rows.
    """
    source = docs.select("doc_id", "text")
    rows = stored(source.mapInArrow(_signatures(shingle), SIGNATURES), "signatures")
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = source.join(nodes.select("doc_id", "node", "d1"), "doc_id").select("node", "d1", "text")
    regions = stored(_shared(texts.mapInArrow(_project(shingle, 0), REGIONS)), "regions")
    some = nodes.join(regions.select("node").distinct(), "node", "left_semi").select("doc_id", "node", "d1")
    near = stored(source.join(some, "doc_id").select("node", "d1", "text").mapInArrow(_look(shingle), NEAR).dropDuplicates(["node"]), "near")

    links, level = [], 0
    while regions is not None:
        following = _round(near, regions, links, shingle, level)
        discard(regions)
        regions, level = following, level + 1
    discard(near)
    group = nodes.join(_labels(links), "node", "left").select("d1", "d2", "n", "doc_id", F.coalesce("component", "node").alias("component"))
    group = stored(group, "groups")
    least = group.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = stored(group.join(least, "component").select("d1", "d2", "n", "component_id"), "known")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    same = rows.join(known, ["d1", "d2", "n"], "left")
    return same.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@query(
    "op8_jaccard_join",
    """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
       sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s+4], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
       n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
       common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
       link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
       reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
       SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
       FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
