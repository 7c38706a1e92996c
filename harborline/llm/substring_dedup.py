"""Removal of long passages that an earlier document already has, over a De Bruijn graph of words.

Edges of the graph are the windows of ``window`` consecutive words. Each window names its smallest inner
k-mer as its anchor, so a run of neighbouring windows with one anchor is a path that depends on nothing
but its own words, and one row stands for it: about a dozen edges. Equal paths meet in a Spark
aggregation by (anchor, path), which keeps the smallest document and the path's place in it. An anchor with
a single path doesn't branch, and its path is decided as a whole. Only where several paths share an anchor
does one copy of each go back to its source coordinates for its single edges, which meet in the same way.
Then neighbouring paths with one source and one diagonal compact to long spans, a digest of the words at
the source's coordinates joins each span, and a span goes only if its own words have that digest.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.llm.common import discard, documents, flat_text, slices, stored
from harborline.llm.hashing import U, Words, mix, prefix, spans
from harborline.llm.registry import query

WINDOW = 50
#: Bytes of text that are hashed at a time.
SLICE = 2 << 20
#: ``at``: a tag of the text in the upper half, which tells rows of one id apart, and the first window.
PATHS = "anchor long, path long, doc_id long, at long, edges int"


class _Graph:
    """Anchors and paths of a batch of texts."""

    def __init__(self, column: pa.Array, window: int):
        self.words = w = Words(*flat_text(column))
        self.sums, self.other, self.window = prefix(w.hashes()), prefix(w.hashes(1), 1), window

    def edges(self, starts: np.ndarray) -> np.ndarray:
        return spans(self.other, starts, starts + self.window, 1)

    def paths(self):
        """Arrays anchor, path, text, first window and number of windows."""
        w, k = self.words, self.window // 2
        n = len(w.starts) - k + 1
        at = w.positions(self.window)
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        kmer = np.arange(n)
        value = spans(self.sums, kmer, kmer + k)
        low, where, width, whole = value, kmer, 1, self.window - k + 1  # smallest of ``width`` k-mers from each on, the first of equals
        while width < whole:
            step = min(width, whole - width)
            right = low[step:] < low[: len(low) - step]
            where = np.where(right, where[step:], where[: len(where) - step])
            low = np.minimum(low[step:], low[: len(low) - step])
            width += step
        anchor = where[at]
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
        first, last = at[cut], at[np.concatenate((cut[1:], [len(at)])) - 1]
        place = anchor[cut]
        with np.errstate(over="ignore"):
            path = mix(spans(self.other, first, last + self.window, 1) + (place - first).astype(np.uint64))
        text = np.searchsorted(w.first, first, "right") - 1
        return value[place].view(np.int64), path.view(np.int64), text, first - w.first[text], last - first + 1


def _batch(b: pa.RecordBatch, anchor, path, text, first, edges) -> pa.RecordBatch:
    tag = b.column("tag").to_numpy()[text]
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(path), b.column("doc_id").take(pa.array(text)), pa.array((tag << 32) + first), pa.array(edges.astype(np.int32))], names=[c.split()[0] for c in PATHS.split(", ")])


def _emit_paths(window: int):
    def run(batches):
        for b in (s for batch in batches for s in slices(batch, "text", SLICE)):
            yield _batch(b, *_Graph(b.column("text"), window).paths())

    return run


def _emit_edges(window: int):
    def run(batches):
        for b in (s for batch in batches for s in slices(batch, "text", SLICE)):
            g, lists = _Graph(b.column("text"), window), b.column("paths")
            text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            first, n, anchor = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "edges", "anchor"))
            begin = np.repeat(np.cumsum(n) - n, n)
            edge = np.repeat(first, n) + np.arange(n.sum()) - begin
            text, anchor = np.repeat(text, n), np.repeat(anchor, n)
            yield _batch(b, anchor, g.edges(edge + g.words.first[text]).view(np.int64), text, edge, np.ones(len(edge)))

    return run


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).alias("tag"))


def _sources(rows: DataFrame) -> DataFrame:
    """By path: the smallest document, the path's place in it, and the largest document."""
    return rows.groupBy("anchor", "path").agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("source_at"), F.max("doc_id").alias("last"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, first, edges, source, source_tag, source_first): spans of windows of a document that a
    document with a smaller id, ``source``, has from its window ``source_first`` on.

    A span of ``edges`` windows from word ``first`` on covers edges + window - 1 words. ``tag`` tells rows
    of one id with different texts apart. Documents with a null id take no part; those with fewer words
    than a window have no rows.
    """
    source = _tagged(docs).filter("doc_id IS NOT NULL")
    paths = stored(source.mapInArrow(_emit_paths(window), PATHS), "paths")
    classes = stored(_sources(paths), "classes")
    branching = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min("source").alias("low"), F.max("last").alias("high")).filter("n > 1 AND low < high").select("anchor")
    branching = stored(branching, "branching")
    known = classes.join(branching.withColumn("branches", F.lit(True)), "anchor", "left").filter("branches OR source < last")
    known = stored(known.select("anchor", "path", "source", "source_at", F.coalesce("branches", F.lit(False)).alias("branches")), "known")
    met = stored(paths.join(known, ["anchor", "path"]).filter("doc_id > source OR branches").select("anchor", "doc_id", "at", "edges", "source", "source_at", (F.col("doc_id") > F.col("source")).alias("whole")), "met")
    discard(paths, classes, branching, known)
    tag, first = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFFFFFF)
    open_paths = met.filter("NOT whole").groupBy("doc_id", tag.alias("tag")).agg(F.collect_list(F.struct(first.alias("first"), "edges", "anchor")).alias("paths"))  # bounded by the document
    single = stored(source.join(open_paths, ["doc_id", "tag"]).mapInArrow(_emit_edges(window), PATHS), "edges")
    origin = stored(_sources(single).filter("source < last").drop("last"), "first-edges")
    later = single.join(origin, ["anchor", "path"]).filter("doc_id > source")
    columns = ["doc_id", "at", "edges", "source", "source_at"]
    pieces = met.filter("whole").select(columns).union(later.select(columns))
    pieces = pieces.select("doc_id", tag.alias("tag"), first.cast("int").alias("first"), "edges", "source", F.shiftright("source_at", 32).alias("source_tag"), F.col("source_at").bitwiseAND(0xFFFFFFFF).cast("int").alias("source_first"))
    out = stored(compacted(pieces), "spans")
    discard(met, single, origin)
    return out


def compacted(pieces: DataFrame) -> DataFrame:
    """Pieces of one diagonal between two texts, each beginning where another ends or before, as one span."""
    diagonal = ["doc_id", "tag", "source", "source_tag", "shift"]
    rows = pieces.withColumns({"shift": F.col("first") - F.col("source_first"), "end": F.col("first") + F.col("edges")})
    along = Window.partitionBy(*diagonal).orderBy("first", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(reach >= F.col("first"), 0).otherwise(1))
    rows = rows.withColumn("number", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans_ = rows.groupBy(*diagonal, "number").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return spans_.select("doc_id", "tag", "first", (F.col("end") - F.col("first")).alias("edges"), "source", "source_tag", (F.col("first") - F.col("shift")).alias("source_first"))


def _digest(words: list[bytes], first: int, edges: int, window: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[first : first + edges + window - 1]))


def _split(texts: pa.Array):
    return ((t or "").encode().split() for t in texts.to_pylist())  # at space and \t..\r


SOURCES = "source long, source_tag long, source_first int, edges int, digest binary"


def _with_digests(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``found`` with the digest of the words at each span's source coordinates."""

    def run(batches):
        for b in (s for batch in batches for s in slices(batch, "text", SLICE)):
            out = []
            for doc, tag, words, asked in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), _split(b.column("text")), b.column("asked").to_pylist()):
                out += [(doc, tag, x["source_first"], x["edges"], _digest(words, x["source_first"], x["edges"], window)) for x in asked]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in SOURCES.split(", ")])

    key = ["source", "source_tag", "source_first", "edges"]
    asked = found.select(*key).distinct().groupBy("source", "source_tag").agg(F.collect_list(F.struct("source_first", "edges")).alias("asked"))  # of one text
    asked = asked.withColumnsRenamed({"source": "doc_id", "source_tag": "tag"})
    digests = stored(_tagged(docs).join(asked, ["doc_id", "tag"]).mapInArrow(run, SOURCES).dropDuplicates(key), "digests")
    return found.join(digests, key)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and with ``text`` also ``kept``: what stays
    without words that lie in a window of an earlier document, joined by single spaces.

    Windows are judged on the input. A null or empty text has no words; a null id keeps everything; rows
    with one id count as one document and are cut each by its own words; an empty table gives no rows.
    Words in which a span differs from its source's words would stay, whatever the hashes say.
    """
    found = _with_digests(docs, repeated_spans(docs, window), window)
    by_doc = stored(found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "edges", "digest")).alias("found")), "by-document")  # of one text
    with_runs = _tagged(docs).join(by_doc, ["doc_id", "tag"], "left")
    schema = RESULT + ", kept string" * text

    def run(batches):
        for b in (s for batch in batches for s in slices(batch, "text", SLICE)):
            rows = []
            for words, found in zip(_split(b.column("text")), b.column("found").to_pylist()):
                kept = words
                if found:
                    away = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        if _digest(words, r["first"], r["edges"], window) == r["digest"]:
                            away[r["first"]] += 1
                            away[r["first"] + r["edges"] + window - 1] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(away[:-1]) == 0).tolist()]
                raw = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(raw).hexdigest(), *([raw.decode()] if text else ())))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=[c.split()[0] for c in schema.split(", ")])

    return with_runs.mapInArrow(run, schema)


@query(
    "op2_substring_dedup",
    """WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
       win AS (SELECT doc_id, s, md5(array_to_string(words[s:s+49], ' ')) AS h
               FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)),
       src AS (SELECT h, min(doc_id) AS source FROM win GROUP BY h),
       bad AS (SELECT doc_id, list(s) AS starts FROM win JOIN src USING (h) WHERE source < doc_id GROUP BY doc_id),
       gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM bad)) GROUP BY doc_id),
       kept AS (SELECT w.doc_id, len(words) AS n_words,
                CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END AS left_words
                FROM w LEFT JOIN gone USING (doc_id))
       SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(left_words))::BIGINT AS n_removed,
              sha256(array_to_string(left_words, ' ')) AS kept_sha256 FROM kept""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), text=False)
