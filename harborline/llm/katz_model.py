"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff weights, scores by token.

Texts become blocks of a few megabytes: a list of the block's word hashes and the texts as positions in
it, written once. A block asks once for each word and each pair of neighbouring words that it has. What
it asks travels by hash to the partition of the count tables that holds the answer, as packed arrays of
64-bit hashes, and the answers come back in the order of the questions. So a key costs one entry a block
and not a row a token, and a frequent word or pair is no heavier than a rare one.

A pair that was seen ``least`` times or more has its discounted relative frequency; any other is the
backoff weight of its first word times the second word's own probability, which for a word that was never
seen is the whole discount of the words.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import LARGE_ROWS, crc_of_id, documents, flat_text, input_bytes, prepare, stored
from harborline.llm.hashing import U, Words, mix
from harborline.llm.registry import query

START, END = 0x5354415254, 0x454E44  # hashes of what stands before and after a text
BLOCK_BYTES = 3 << 20
#: Bytes of written blocks for each part of the tables, which one task holds whole, and for each task that gathers rows by part or block, however few Spark's shuffle partitions are.
PART_BYTES = 16 << 20
BLOCKS = "block long, doc_id array<long>, held array<boolean>, length array<int>, tokens binary, words binary"
ASKED = "part int, block long, words binary, word_n binary, pairs binary, pair_n binary"
ANSWERED = "part int, block long, words binary, pairs binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of first bytes, second bytes and so on, which compress better than rows of them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def _unpack(raw: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


@dataclass(frozen=True)
class Settings:
    """Counts up to ``discounted`` are discounted; pairs seen less than ``least`` times count as unseen."""

    discounted: int = 5
    least: int = 1


def _cut(batch: pa.RecordBatch):
    """``batch`` in runs of rows of about ``BLOCK_BYTES`` of text; a longer text stays whole."""
    ends = flat_text(batch.column("text"))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _write_blocks(batches):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for b in (part for batch in batches for part in _cut(batch)):
        w = Words(*flat_text(b.column("text")), lower=True)
        words, tokens = np.unique(np.concatenate((w.hashes(), [U(END)])), return_inverse=True)
        one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, t))
        yield pa.RecordBatch.from_arrays([pa.array([block]), one(b.column("doc_id"), None), one(b.column("held"), None), one(w.counts.astype(np.int32), pa.int32()), pa.array([_pack(tokens[:-1].astype("<i4"))], pa.binary()), pa.array([_pack(words.astype("<u8"))], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])
        block += 1


class _Block:
    """One row of the blocks: ``at``/``before`` are the positions of each token (ends included) and of the
    one before it in ``words``, where the last position of ``before`` stands for the start of a text."""

    def __init__(self, tokens: bytes, words: bytes, length: np.ndarray, held: np.ndarray):
        self.words = _unpack(words, "<u8")
        flat = _unpack(tokens, "<i4")
        self.last = np.cumsum(length + 1) - 1
        end = int(np.searchsorted(self.words, U(END)))
        self.at = np.full(len(flat) + len(length), end, np.int64)
        inner = np.ones(len(self.at), bool)
        inner[self.last] = False
        self.at[inner] = flat
        self.before = np.concatenate(([0], self.at[:-1]))
        self.first = self.last - length
        self.before[self.first] = len(self.words)
        self.text = np.repeat(np.arange(len(length)), length + 1)
        self.train = ~held[self.text]
        self.names = np.concatenate((self.words, [U(START)]))
        with np.errstate(over="ignore"):
            keys = mix(self.names[self.before] * U(0x9E3779B97F4A7C15) + mix(self.words[self.at] + U(99)))
        self.pairs, self.pair = np.unique(keys, return_inverse=True)

    def word_n(self) -> np.ndarray:
        return np.bincount(self.at[self.train], minlength=len(self.words))

    def pair_n(self) -> np.ndarray:
        return np.bincount(self.pair[self.train], minlength=len(self.pairs))


def _parted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings keys together by part, and where each part begins."""
    part = (keys % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _rows(batches):
    """The blocks in Arrow batches, each with its row's other columns."""
    for b in batches:
        for i in range(len(b)):
            row = b.slice(i, 1)
            flat = lambda c: row.column(c).flatten()
            yield row, _Block(row.column("tokens")[0].as_py(), row.column("words")[0].as_py(), flat("length").to_numpy(), flat("held").fill_null(False).to_numpy(zero_copy_only=False))


def _ask(parts: int):
    def run(batches):
        for row, k in _rows(batches):
            block = row.column("block")[0].as_py()
            columns = []
            for keys, n in ((k.words, k.word_n()), (k.pairs, k.pair_n())):
                order, cut = _parted(keys, parts)
                for values in (keys[order].astype("<u8"), n[order].astype("<i4")):
                    columns.append(pa.array([_pack(values[a:z]) for a, z in zip(cut, cut[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, block)), *columns], names=[c.split()[0] for c in ASKED.split(", ")])

    return run


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


def _count(discounted: int):
    """Answers of one part: (count << 1) + whether the block is the first to ask, in the order asked. A row
    with block -1 has the part's own totals: tokens, types, and how many words and pairs have each count."""

    def run(key, table):
        out, totals = [], []
        for c, n in (("words", "word_n"), ("pairs", "pair_n")):
            keys, cut = _joined(table.column(c), "<u8")
            own, _ = _joined(table.column(n), "<i4")
            _, first, where = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(where, own).astype(np.int64)
            values = total[where] << 1
            values[first] += 1
            out.append([_pack(values[a:z].astype("<i8")) for a, z in zip(cut, cut[1:])])
            totals.append(np.concatenate(([total.sum(), (total > 0).sum()], [(total == r).sum() for r in range(1, discounted + 2)])).astype("<i8").tobytes())
        parts = [key[0].as_py()] * (len(table) + 1)
        return pa.table([pa.array(parts, pa.int32()), pa.array([*table.column("block").to_pylist(), -1], pa.int64()), pa.array([*out[0], totals[0]], pa.binary()), pa.array([*out[1], totals[1]], pa.binary())], names=[c.split()[0] for c in ANSWERED.split(", ")])

    return run


def good_turing(of: np.ndarray, discounted: int) -> np.ndarray:
    """The factor for each count up to ``discounted`` + 1 (and beyond, by the last), from the numbers of
    types seen 1, 2, ... times; 1 where the estimate is no discount."""
    d = np.ones(discounted + 2)
    if of[0] > 0:
        beyond = (discounted + 1) * of[discounted] / of[0]
        for r in range(1, discounted + 1):
            if of[r - 1] > 0 and beyond < 1:
                x = ((r + 1) * of[r] / of[r - 1] / r - beyond) / (1 - beyond)
                d[r] = x if 0 < x < 1 else 1.0
    return d


class _Model:
    """Totals and discounts, a few numbers."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, settings: Settings):
        self.settings, self.tokens, self.types = settings, int(words[0]), int(words[1])
        k = settings.discounted
        self.word_d, self.pair_d = good_turing(words[2:], k), good_turing(pairs[2:], k)
        lost = sum((1 - self.word_d[r]) * r * int(words[1 + r]) for r in range(1, k + 1)) / max(1, self.tokens)
        self.keep = 1.0 if lost > 0 else self.tokens / (self.tokens + 1)  # no discount: one more token than seen
        self.unknown = lost if lost > 0 else 1 / (self.tokens + 1)

    def word_p(self, n: np.ndarray) -> np.ndarray:
        seen = self.keep * self.word_d[np.minimum(n, self.settings.discounted + 1)] * n / max(1, self.tokens)
        return np.where(n > 0, seen, self.unknown)

    def pair_c(self, n: np.ndarray) -> np.ndarray:
        """Discounted counts, 0 for pairs that count as unseen."""
        return np.where(n >= self.settings.least, self.pair_d[np.minimum(n, self.settings.discounted + 1)] * n, 0.0)


def _answers(row, answers: str, column: str, keys: np.ndarray, parts: int, dtype) -> np.ndarray:
    """What came back for ``keys``, in their own order."""
    order, _ = _parted(keys, parts)
    got = row.column(answers).flatten()
    by = np.argsort(got.field("part").to_numpy())
    out = np.empty(len(keys), dtype)
    out[order] = _joined(got.field(column).take(pa.array(by)), dtype)[0]
    return out


def _contexts(model: _Model, parts: int, texts: int):
    """By first word: how often a word follows, and the discounted counts and probabilities of its pairs,
    summed over those the block owns."""

    def run(batches):
        for row, k in _rows(batches):
            words, pairs = _answers(row, "answers", "words", k.words, parts, "<i8") >> 1, _answers(row, "answers", "pairs", k.pairs, parts, "<i8")
            mine = np.flatnonzero((pairs & 1 == 1) & (pairs >> 1 >= model.settings.least))
            some = np.zeros(len(k.pairs), np.int64)
            some[k.pair] = np.arange(len(k.pair))
            token = some[mine]
            u, p = k.before[token], model.word_p(words)[k.at[token]]
            size = len(k.names)
            add = lambda x: np.bincount(u, x, size).astype(np.float64)  # noqa: E731  of nothing, bincount makes integers
            c, p = add(model.pair_c(pairs[mine] >> 1)), add(p)
            there = np.flatnonzero(np.bincount(u, minlength=size))
            n = np.append(words, texts)[there]
            yield pa.RecordBatch.from_arrays([pa.array(k.names[there].view(np.int64)), pa.array((k.names[there] % U(parts)).astype(np.int32)), pa.array(n), pa.array(c[there]), pa.array(p[there])], names=["word", "part", "n", "c", "p"])

    return run


def backoff_weight(n, c, p):
    """The weight that makes a word's pairs sum to one, from how often a word follows it and the sums over
    its seen pairs. Negative where the pairs leave nothing: then they count as one more than were seen."""
    full = n - c < 1e-9
    weight = (1 - c / np.where(full, n + 1, n)) / np.maximum(1 - p, 1e-300)
    return np.where(full, -weight, weight)


def _look_up(key, asked, sums):
    """Backoff weights of each block's words of a part; 1 for words without a seen pair."""
    word, n, c, p = (sums.column(x).to_numpy() for x in ("word", "n", "c", "p"))
    word = np.ascontiguousarray(word).view(np.uint64)
    o = np.argsort(word)
    keys, cut = _joined(asked.column("words"), "<u8")
    out = np.ones(len(keys))
    if len(word) and len(keys):
        i = np.minimum(np.searchsorted(word[o], keys), len(word) - 1)
        hit = word[o][i] == keys
        out[hit] = backoff_weight(n, c, p)[o][i][hit]
    raw = [_pack(out[a:z]) for a, z in zip(cut, cut[1:])]
    return pa.table([pa.array([key[0].as_py()] * len(raw), pa.int32()), asked.column("block"), pa.array(raw, pa.binary())], names=["part", "block", "weights"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: _Model, parts: int, start: float, texts: int):
    def run(batches):
        for row, k in _rows(batches):
            n = _answers(row, "answers", "words", k.words, parts, "<i8") >> 1
            pair = (_answers(row, "answers", "pairs", k.pairs, parts, "<i8") >> 1)[k.pair]
            weight = np.append(_answers(row, "weights", "weights", k.words, parts, "<f8"), start)
            total = np.append(n, texts) + (weight < 0)  # how often each word has a word after it
            known = model.pair_c(pair)
            word = model.word_p(n)[k.at]
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.log10(np.where(known > 0, known / total[k.before], np.abs(weight)[k.before] * word))
            count = n[k.at]
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            add = lambda x: np.add.reduceat(x, k.first) if len(k.first) else np.zeros(0)
            length = k.last - k.first + 1
            held = row.column("held").flatten()
            yield pa.RecordBatch.from_arrays([row.column("doc_id").flatten(), held, pa.array(length.astype(np.int64)), pa.array(add((count > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(length), model.tokens, np.int64)), pa.array(add(base)), pa.array(add(logs))], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def katz_scores(docs: DataFrame, held_out, settings: Settings = Settings()) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by a model of those where the column ``held_out`` is false.

    base_score adds log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens; score is the text's log10
    probability under the model. Tokens are lower-cased words and one end a text, so a null or empty text
    is its end alone; repeated rows count as often as they occur; a null ``held_out`` counts as false; an
    empty table gives no rows. Without a training token every probability is 1.
    """
    spark = docs.sparkSession
    prepare(spark)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held")).mapInArrow(_write_blocks, BLOCKS), "blocks", LARGE_ROWS)
    least = input_bytes(blocks) // PART_BYTES
    parts = max(2 * shuffled, least)
    by = lambda t, key: (t.repartition(least, key) if least > shuffled else t).groupBy(key)
    asked = blocks.select("block", "held", "length", "tokens", "words").mapInArrow(_ask(parts), ASKED)
    answered = stored(by(asked, "part").applyInArrow(_count(settings.discounted), ANSWERED), "answered", LARGE_ROWS)
    words, pairs = (np.zeros(settings.discounted + 3, np.int64) for _ in range(2))
    for r in answered.filter("block = -1").collect():  # a few numbers a part
        words += np.frombuffer(r["words"], "<i8")
        pairs += np.frombuffer(r["pairs"], "<i8")
    model = _Model(words, pairs, settings)

    texts = docs.filter(~F.coalesce(held_out, F.lit(False))).count()
    by_block = by(answered.filter("block >= 0"), "block").agg(F.collect_list(F.struct("part", "words", "pairs")).alias("answers"))  # a row a part
    own = blocks.join(by_block, "block")
    sums = own.mapInArrow(_contexts(model, parts, texts), "word long, part int, n long, c double, p double")
    sums = stored(sums.groupBy("word", "part").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.sum("p").alias("p")), "contexts")
    lists = blocks.select("block", "words").mapInArrow(_ask_words(parts), "part int, block long, words binary")
    weights = stored(by(lists, "part").cogroup(by(sums, "part")).applyInArrow(_look_up, "part int, block long, weights binary"), "weights")
    first = sums.filter(F.col("word") == START).select("n", "c", "p").first()
    to_score = own.join(by(weights, "block").agg(F.collect_list(F.struct("part", "weights")).alias("weights")), "block")
    return to_score.mapInArrow(_score(model, parts, float(backoff_weight(*first)) if first else 1.0, texts), SCORES)


def _ask_words(parts: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                keys = _unpack(b.column("words")[i].as_py(), "<u8")
                order, cut = _parted(keys, parts)
                keys = keys[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, b.column("block")[i].as_py())), pa.array([_pack(keys[a:z]) for a, z in zip(cut, cut[1:])], pa.binary())], names=["part", "block", "words"])

    return run


@query("op10_katz_backoff")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), crc_of_id("doc_id") % 10 == 0, Settings(least=1))
