"""Quality rules: word, symbol and repetition limits, and language-specific perplexity bands.

The perplexity is that of an interpolated modified Kneser-Ney model over trigrams of tokens, one model a
language, counted by Spark over all documents (``token_model``). A coarse spelling model of the same kind
over characters has a band of its own: its characters fold into 64 symbols, so it has at most 64**3 n-grams
whatever the corpus size and travels as sorted arrays of n-gram hashes with their probabilities and backoff
weights. A document must lie within both bands of its language. Copies of a text vouch for one another in
the token model, so that one has no lower end, or all copies would go with their original; texts of too few
different characters fall below the other.
"""
from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import discard, documents, flat_text, free_name, slices, stored
from harborline.llm.hashing import Words, mix, prefix, spans
from harborline.llm.registry import query
from harborline.llm.token_model import span_scores

SYMBOLS = 64
UNKNOWN = "und"
#: Width of a bin of bits per character in the histogram that gives the bands.
BIN = 0.01
#: Characters of a block.
BLOCK = 128
#: Bytes of text that are measured at a time.
SLICE = 1 << 20
_SMALL = 0x250


@dataclass(frozen=True)
class Rules:
    """The limits. A document needs ``min_words`` words and at most ``max_repeat`` percent of them in
    repeated 3-word windows. Its bits per character may lie ``lower`` below, and these and its bits per token
    ``upper`` robust standard deviations above its language's median, and always within ``least`` bits of it (a
    token: ``least_token``); the fewer spans or blocks a text has, the wider is its band."""

    min_words: int = 50
    max_repeat: int = 50
    lower: float = 6.0
    upper: float = 5.0
    least: float = 0.12
    least_token: float = 0.4


def _symbols() -> np.ndarray:
    """The symbol of each code point below ``_SMALL``: 0 white space, 1-26 letters, 27 digits, 28-47 marks
    and accented letters by a fixed hash; 48-63 (all others) by ``_fold``."""
    out = np.zeros(_SMALL, np.uint8)
    for c in range(_SMALL):
        ch = chr(c).lower()[0]
        if ch.isspace() or c < 32:
            out[c] = 0
        elif "a" <= ch <= "z":
            out[c] = ord(ch) - 96
        elif ch.isdigit():
            out[c] = 27
        elif unicodedata.category(ch)[0] == "L":
            out[c] = 36 + ord(ch) % 12
        else:
            out[c] = 28 + ord(ch) % 8
    return out


_TABLE = _symbols()


def _fold(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if points.size and points.max() >= _SMALL:
        return np.where(points < _SMALL, _TABLE[np.minimum(points, _SMALL - 1)], 48 + points % 16)
    return _TABLE[points]


def _codes(text: str) -> np.ndarray:
    """The trigram ending at each character, as one number; two spaces stand before the text."""
    s = np.concatenate((np.zeros(2, np.int32), _fold(text).astype(np.int32)))
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


#: Languages that a task counts at a time, 2 MB each.
LANGUAGES = 16


def _count(batches):
    counts: dict[str, np.ndarray] = {}

    def rows():
        for lang, have in counts.items():
            code = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(have[code])], names=["lang", "code", "n"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if text:
                have = counts.get(lang)
                if have is None:
                    if len(counts) >= LANGUAGES:
                        yield from rows()
                    have = counts[lang] = np.zeros(SYMBOLS**3, np.int64)
                if len(text) > 20_000:
                    have += np.bincount(_codes(text), minlength=SYMBOLS**3)
                else:
                    u, c = np.unique(_codes(text), return_counts=True)
                    have[u] += c
    yield from rows()


def _ngram_hash(order: int, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(code.astype(np.uint64) + np.uint64(order << 40))


class KneserNey:
    """Interpolated modified Kneser-Ney over symbols, as sorted hash arrays for each order."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        bigram, bigram_n = np.unique(code & 0xFFF, return_counts=True)  # continuation counts
        unigram, unigram_n = np.unique(bigram & 0x3F, return_counts=True)
        self.levels = [self._level(3, code, n), self._level(2, bigram, bigram_n), self._level(1, unigram, unigram_n)]

    @staticmethod
    def _level(order: int, code: np.ndarray, n: np.ndarray):
        of = [max(1, int((n == k).sum())) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = np.array([0.0, *(min(float(k), max(0.1, k - (k + 1) * y * of[k] / of[k - 1])) for k in (1, 2, 3))])
        discount = d[np.minimum(n, 3)]
        context, at = np.unique(code >> 6, return_inverse=True)
        total = np.bincount(at, n)
        kept = np.maximum(n - discount, 0) / total[at]
        rest = np.bincount(at, np.minimum(discount, n)) / total
        key, ckey = _ngram_hash(order, code), _ngram_hash(order + 8, context)
        o, c = np.argsort(key), np.argsort(ckey)
        return key[o], kept[o], ckey[c], rest[c]

    def table(self) -> np.ndarray:
        """Bits of every trigram, from lookups in the sorted arrays."""

        def look(keys, values, wanted, missing):
            i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[i] == wanted, values[i], missing)

        p = np.full(1, 1.0 / SYMBOLS)
        for order, (key, kept, ckey, rest) in zip((1, 2, 3), reversed(self.levels)):
            code = np.arange(SYMBOLS**order)
            p = look(key, kept, _ngram_hash(order, code), 0.0) + look(ckey, rest, _ngram_hash(order + 8, code >> 6), 1.0) * p[code & (SYMBOLS ** (order - 1) - 1)]
        return -np.log2(p)


def train(docs: DataFrame) -> dict[str, KneserNey]:
    """A model for each language of ``docs`` (null: ``und``), counted over all whole texts.

    What comes to the driver has at most 64**3 rows a language. An empty table gives no models.
    """
    rows = _input(docs).select("lang", "text").mapInArrow(_count, "lang string, code int, n long")
    found: dict[str, tuple[list, list]] = {}
    for t in rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang in t.column("lang").unique().to_pylist():
            some = t.filter(pa.compute.equal(t.column("lang"), lang))
            c, n = found.setdefault(lang, ([], []))
            c.append(some.column("code").to_numpy())
            n.append(some.column("n").to_numpy())
    models = {}
    for lang, (c, n) in sorted(found.items()):
        code, n = np.concatenate(c).astype(np.int64), np.concatenate(n)
        o = np.argsort(code)
        models[lang] = KneserNey(code[o], n[o])
    return models


def _input(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lang", F.coalesce(F.col("lang"), F.lit(UNKNOWN)))


class _Scorer:
    def __init__(self, models):
        self.models, self.tables = models, {}

    def bits(self, lang: str, text: str | None) -> tuple[float, float]:
        """Bits of a character: the median and the mean over blocks of the text; 0 without any character."""
        if not text or lang not in self.models:
            return 0.0, 0.0
        blocks = self._blocks(lang, text)
        return float(np.median(blocks)), float(blocks.mean())

    def _blocks(self, lang: str, text: str) -> np.ndarray:
        """Bits of a character in blocks of ``BLOCK`` characters or up to twice as many, which share all
        characters evenly."""
        if lang not in self.tables:
            if len(self.tables) >= LANGUAGES:
                self.tables.clear()
            self.tables[lang] = self.models[lang].table().astype(np.float32)
        bits = self.tables[lang][_codes(text)]
        k = max(1, len(bits) // BLOCK)
        edges = np.arange(k + 1) * len(bits) // k
        return np.add.reduceat(bits, edges[:-1], dtype=np.float64) / np.diff(edges)


def perplexity_bands(scored: DataFrame, bits, rules: Rules, least: float) -> dict[str, tuple[float, float, float]]:
    """(median, width below, width above) of the column ``bits`` for each ``lang``, from the histogram over all rows
    with enough words."""
    enough = scored.filter(F.col("rows.quality.n_words") >= rules.min_words)
    bins = enough.groupBy("lang", F.round(bits / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by: dict[str, list[tuple[int, int]]] = {}
    for r in bins.collect():  # bits of a symbol or token are bounded, so are the bins
        by.setdefault(r["lang"], []).append((r["bin"], r["n"]))

    def median(rows):
        rows = sorted(rows)
        half, at = sum(n for _, n in rows) / 2, 0
        for x, n in rows:
            at += n
            if at >= half:
                return x
        return 0

    out = {}
    for lang, rows in by.items():
        mid = median(rows)
        spread = 1.4826 * BIN * median([(abs(x - mid), n) for x, n in rows])
        out[lang] = mid * BIN, max(least, rules.lower * spread), max(least, rules.upper * spread)
    return out


SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


def _per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[cuts])


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    raw, offs = flat_text(column)
    words = Words(raw, offs)
    n = len(words.starts)
    left = np.repeat(words.first[1:], words.counts) - np.arange(n)
    p = np.flatnonzero(left >= 3)
    with np.errstate(over="ignore"):
        key = mix(spans(prefix(words.hashes()), p, p + 3) + words.docs()[p].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    s = np.sort(key)
    more = np.unique(s[1:][s[1:] == s[:-1]])  # few, so looking them up costs less than sorting places
    twice = more[np.minimum(np.searchsorted(more, key), len(more) - 1)] == key if len(more) else np.zeros(len(p), bool)
    again = np.zeros(n + 3, bool)
    for k in range(3):
        again[p[twice] + k] = True
    dup = []
    for text in column.to_pylist():
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if text and "\n" in text else ()
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_text(words.inside & _LEAD[raw], offs),
        "n_symbols": _per_text(SYMBOL_BYTES[raw], offs),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _per_text(again[:n], words.first),
    }


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bits_per_char double, kept boolean, bits_per_token double"


def quality_rules(docs: DataFrame, rules: Rules = Rules(), carry: list[str] | None = None, verdict: str = "quality") -> DataFrame:
    """The columns ``carry`` (all by default) of every document and, in a struct named ``verdict``, its verdict.

    kept is false if the base rules fail or if the bits per token or per character lie outside the band of the
    document's own language: neither their median nor their mean over the spans or blocks of the text may lie
    above it, and the median per character not below. What other languages' models say doesn't count. A null or
    empty text has no words and fails; a null language counts as ``und``; equal rows get equal verdicts; an empty
    table gives no rows; where ``docs`` has a column of the name ``verdict``, choose another. Texts are read whole.
    """
    spark = docs.sparkSession
    models = train(docs)
    sent = spark.sparkContext.broadcast(models)
    carry = docs.columns if carry is None else carry
    fields = [*VERDICT.split(", ")[:-2], "mean_bits double", "blocks int"]
    names = [c.split()[0] for c in fields]
    text_at = carry.index("text") if "text" in carry else len(carry)

    def run(batches):
        scorer = _Scorer(sent.value)
        for b in (s for batch in batches for s in slices(batch, f"c{text_at}", SLICE)):
            text, lang = b.column(text_at), b.column(b.num_columns - 1).to_pylist()
            m = measures(text)
            bits, mean = np.array([scorer.bits(k, t) for k, t in zip(lang, text.to_pylist())], float).reshape(-1, 2).T
            blocks = np.maximum(1, np.asarray(pa.compute.utf8_length(text).fill_null(0)) // BLOCK).astype(np.int32)
            failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat * m["n_words"])
            values = [*m.values(), failed, bits, mean, blocks]
            quality = pa.StructArray.from_arrays([pa.array(v) for v in values], names)
            row = pa.StructArray.from_arrays([*(b.column(i) for i in range(len(carry))), quality], [*(f"c{i}" for i in range(len(carry))), "quality"])
            yield pa.RecordBatch.from_arrays([b.column(b.num_columns - 1), text, row], names=["lang", "text", "row"])

    columns = carry if "text" in carry else [*carry, "text"]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("language"))
    row = ", ".join([*(f"c{i}: {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)), f"quality: struct<{', '.join(x.replace(' ', ':') for x in fields)}>"])
    blocks, scores = span_scores(source, f"struct<{row}>", run)
    each = blocks.join(scores.hint("shuffle_hash"), "block").select("lang", F.inline(F.arrays_zip("rows", "median", "mean", "spans")))
    quality = F.col("rows.quality")
    characters = perplexity_bands(each, quality["bits_per_char"], rules, rules.least)
    tokens = perplexity_bands(each, F.col("median"), rules, rules.least_token)
    limits = [(lang, *x, tokens[lang][0], tokens[lang][2]) for lang, x in characters.items()]
    each = each.join(F.broadcast(spark.createDataFrame(limits, "lang string, mid double, below double, above double, token double, token_above double")), "lang", "left")
    wider, token_wider = F.sqrt(1 + 4 / quality["blocks"]), F.sqrt(1 + 4 / F.col("spans"))
    spelt = (quality["bits_per_char"] >= F.col("mid") - F.col("below") * wider) & (F.greatest(quality["bits_per_char"], quality["mean_bits"]) <= F.col("mid") + F.col("above") * wider)
    within = spelt & (F.greatest("median", "mean") <= F.col("token") + F.col("token_above") * token_wider)
    full = F.struct(*(quality[n].alias(n) for n in names[:-2]), (~quality["base_failed"] & F.coalesce(within, F.lit(True))).alias("kept"), F.col("median").alias("bits_per_token"))
    judged = each.select(*(F.col("rows")[f"c{i}"].alias(c) for i, c in enumerate(carry)), full.alias(verdict))
    judged._tables = [blocks, scores]
    return judged


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) that are kept. Only ids and digests of texts go through
    the tables of the token model, which are deleted before this returns; the rows then join with those kept."""
    # a verdict depends on text and language alone; the id spreads copies over the tasks of the join
    own = (F.col("doc_id"), F.coalesce("lang", F.lit(UNKNOWN)), F.unhex(F.sha2("text", 256)))
    names = [free_name(docs, c) for c in ("kept_id", "kept_lang", "kept_text")]
    judged = quality_rules(docs.select("lang", "text", *(c.alias(n) for n, c in zip(names, own))), rules, names)
    kept = stored(judged.filter("quality.kept").select(*names), "kept")
    discard(*judged._tables)
    same = [a.eqNullSafe(F.col(n)) for n, a in zip(names, own)]
    return docs.join(kept, reduce(lambda a, b: a & b, same), "left_semi")


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "quality.*")
