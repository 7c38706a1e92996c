"""Token trigram models, one a language: interpolated modified Kneser-Ney, each token left out of its own counts.

Tokens are those of a public byte-level vocabulary, so every script has its own tokens and nothing is unknown.
Documents of one language become blocks of some megabytes, written once. A block asks for each of its different
trigrams once; what it asks travels by the first two tokens (how often the trigram and its context occur) and,
in a second round, by the last two (how many tokens stand before a pair). Both answers come back to the block.
Counts are those of all texts; a language's pairs are summed by token, two numbers of that kind for each
token of the vocabulary, whatever the corpus size. A text's own trigrams don't vouch for it: each token is
judged by the counts without that one occurrence of it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import discard, flat_text, input_bytes, new_path, stored
from harborline.llm.hashing import U, mix
from harborline.llm.tokens import END_ID, encoder

#: Ids are below START, which stands twice before each text.
START = 0xFFFF
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Languages that a task holds back at a time.
LANGUAGES = 16
#: Trigrams that are scored at a time.
SLICE = 1 << 18
#: Tokens of a span that is scored as one.
SPAN = 64
ASKED = "lang string, part int, block long, keys binary, n binary"
ANSWERED = "lang string, part int, block long, counts binary, contexts binary"
SPANS = "block long, median array<double>, mean array<double>, spans array<int>"


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of first bytes, second bytes and so on, compressed, behind their size in bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _write_blocks(row_type: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, {}

        def flush(lang):
            nonlocal block
            tables, _ = held.pop(lang)
            t = pa.Table.from_batches(tables)
            ids, offs = encoder().encode(t.column("text").combine_chunks(), END_ID)
            rows = t.column("row").combine_chunks().cast(row_type)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang], pa.string()), one(pa.array(np.diff(offs).astype(np.int32))), pa.array([_pack(ids.astype("<u2"))], pa.binary()), one(rows)], names=["block", "lang", "length", "tokens", "rows"])
            block += 1

        for b in batches:
            for lang in b.column("lang").unique().to_pylist():
                some = b.filter(pa.compute.equal(b.column("lang"), lang))
                if lang not in held and len(held) >= LANGUAGES:
                    yield from flush(max(held, key=lambda x: held[x][1]))
                have = held.setdefault(lang, ([], 0))
                held[lang] = [*have[0], some], have[1] + len(flat_text(some.column("text"))[0])
                if held[lang][1] >= BLOCK_BYTES:
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return run


def _different(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them; values are below 2**bits. Numbers are
    sorted many times as fast as places, so each carries its place along where there is room."""
    size = len(values).bit_length()
    if bits + size > 64:
        return np.unique(values, return_inverse=True)
    s = np.sort(values << U(size) | np.arange(len(values), dtype=U))
    v, at = s >> U(size), np.empty(len(s), np.int64)
    new = np.ones(len(s), bool)
    new[1:] = v[1:] != v[:-1]
    at[(s & U((1 << size) - 1)).view(np.int64)] = np.cumsum(new) - 1
    return v[new], at


def _part(pair: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(pair) % U(parts)


def _pairs(a: np.ndarray, b: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs as numbers in the order of their parts, and the place of each pair among them."""
    pair, at = _different(a.astype(U) << U(16) | b, 32)
    order = np.argsort(_part(pair, parts) << U(32) | pair)
    place = np.empty(len(pair), np.int64)
    place[order] = np.arange(len(pair))
    return pair[order], place[at]


class _Grams:
    """A block's tokens ``w`` with the two before each, ``u`` and ``v``."""

    def __init__(self, tokens: bytes, length: np.ndarray):
        self.w = _unpack(tokens, "<u2").astype(np.uint32)
        self.length, self.first = length, np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
        self.v, self.u = np.roll(self.w, 1), np.roll(self.w, 2)
        self.v[self.first] = self.u[self.first] = START
        self.u[self.first[length > 1] + 1] = START

    def ask(self, backward: bool, parts: int):
        """Sets ``keys``, the different trigrams (a, b, c) as numbers in the order of their parts, where the part depends
        on a and b only, ``cut``, where each part begins, and ``n``, how often each occurs."""
        a, b, c = (self.v, self.w, self.u) if backward else (self.u, self.v, self.w)
        pair = a.astype(U) << U(16) | b
        s = np.sort(_part(pair, parts) << U(48) | pair << U(16) | c)
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        keys, self.n = s[starts], np.diff(np.concatenate((starts, [len(s)])))
        self.cut = np.searchsorted(keys >> U(48), np.arange(parts + 1, dtype=U))
        self.keys = keys & U((1 << 48) - 1)
        return self

    def different(self, parts: int):
        """(at, context, v, w, before): the trigram of each token among the different ones in the order of ``ask``,
        and of each of these its context's place, its last two tokens, and their pair's place backward."""
        pair, of = _pairs(self.u, self.v, parts)
        grams, at = _different(of.view(U) << U(16) | self.w, 16 + len(pair).bit_length())
        context = (grams >> U(16)).view(np.int64)
        v, w = (pair[context] & U(0xFFFF)).view(np.int64), (grams & U(0xFFFF)).view(np.int64)
        return at, context, v, w, _pairs(v, w.view(U), parts)[1]


def _rows(batches):
    for b in batches:
        for i in range(len(b)):
            row = b.slice(i, 1)
            yield row, _Grams(row.column("tokens")[0].as_py(), row.column("length").flatten().to_numpy())


def _ask(backward: bool, parts: int):
    def run(batches):
        for row, g in _rows(batches):
            g.ask(backward, parts)
            some = [(p, a, z) for p, (a, z) in enumerate(zip(g.cut, g.cut[1:])) if z > a]
            keys = [_pack(np.diff(g.keys[a:z], prepend=U(0)).astype("<u8")) for _, a, z in some]
            n = [None if backward else _pack(g.n[a:z].astype("<u4")) for _, a, z in some]
            yield pa.RecordBatch.from_arrays([pa.array([row.column("lang")[0].as_py()] * len(some), pa.string()), pa.array([p for p, *_ in some], pa.int32()), pa.array([row.column("block")[0].as_py()] * len(some), pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], names=[c.split()[0] for c in ASKED.split(", ")])

    return run


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _count(backward: bool):
    """Forward: the count of each trigram, and of each context how often it occurs and how many tokens follow it
    once, twice and more often. Backward: how many tokens stand before each pair. Block -1 has sums of the part."""

    def run(key, table):
        asked = [np.cumsum(_unpack(x, "<u8")) for x in table.column("keys").to_pylist()]
        cut = np.cumsum([0, *map(len, asked)])
        types, at = np.unique(np.concatenate(asked), return_inverse=True)
        context = types >> U(16)
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(types)]))))
        if backward:
            stats = [np.diff(np.concatenate((starts, [len(types)])))]
            v, w = (context[starts] >> U(16)).astype(np.int64), (context[starts] & U(0xFFFF)).astype(np.int64)
            n = stats[0]
            sums = [np.bincount(v, x, START + 1) for x in (n, n == 1, n == 2, n >= 3)] + [np.bincount(w, minlength=START + 1), _of_counts(n)]
        else:
            c = np.bincount(at, np.concatenate([_unpack(x, "<u4") for x in table.column("n").to_pylist()])).astype(np.int64)
            stats = [np.add.reduceat(x.astype(np.int64), starts) for x in (c, c == 1, c == 2, c >= 3)]
            sums = [_of_counts(c)]
        counts, contexts = [], []
        for a, z in zip(cut, cut[1:]):
            mine = at[a:z]
            ctx = of[mine]
            ctx = ctx[np.concatenate(([True], ctx[1:] != ctx[:-1]))]
            counts.append(b"" if backward else _pack(c[mine].astype("<u4")))
            contexts.append(_pack(np.concatenate([x[ctx] for x in stats]).astype("<u4")))
        k = len(table) + 1
        return pa.table([pa.array([key[0].as_py()] * k, pa.string()), pa.array([key[1].as_py()] * k, pa.int32()), pa.array([*table.column("block").to_pylist(), -1], pa.int64()), pa.array([*counts, _pack(np.concatenate(sums).astype("<i8"))], pa.binary()), pa.array([*contexts, None], pa.binary())], names=[x.split()[0] for x in ANSWERED.split(", ")])

    return run


def _add(key, table):
    total = sum(_unpack(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([_pack(total)], pa.binary())], names=["lang", "counts"])


def discounts(of: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and from 3 on, from how many grams have counts 1 to 4."""
    of = np.maximum(of, 1)
    y = of[0] / (of[0] + 2 * of[1])
    return np.array([0.0, *(min(float(k), max(0.1, k - (k + 1) * y * of[k] / of[k - 1])) for k in (1, 2, 3))])


def share(c, total, once, twice, more, d, without):
    """(own probability, weight of the shorter context) of a gram seen ``c`` times in a context seen ``total`` times,
    where ``without`` tells whether one occurrence of it is left out."""
    less = c - without
    once = once - (without & (c == 1)) + (without & (c == 2))
    twice = twice - (without & (c == 2)) + (without & (c == 3))
    more = more - (without & (c == 3))
    total = total - without
    some = np.maximum(total, 1)
    own = np.maximum(less - d[np.minimum(less, 3)], 0) / some
    return np.where(total > 0, own, 0.0), np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / some, 1.0)


class Language:
    """A language's discounts, and for each token how many trigrams have it in the middle, by how many tokens stand
    before the pair, and in how many pairs it is the second."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, vocabulary: int):
        self.d3, self.vocabulary = discounts(forward), vocabulary
        self.middle, self.second = backward[: 4 * (START + 1)].reshape(4, -1), backward[4 * (START + 1) : 5 * (START + 1)]
        self.d2 = discounts(backward[-4:])
        self.d1, self.pairs = discounts(_of_counts(self.second)), int(self.second.sum())
        self.levels = [int((self.second == k).sum()) for k in (1, 2)] + [int((self.second >= 3).sum())]

    def bits(self, v, w, c, context, before) -> np.ndarray:
        """Bits of tokens ``w`` behind ``v``, from their trigrams' counts, the four numbers of their contexts, and
        the tokens before their pairs."""
        every = np.ones(len(w), bool)
        a3, b3 = share(c, *context, self.d3, every)
        alone = c == 1
        a2, b2 = share(before, *(x[v] for x in self.middle), self.d2, alone)
        a1, b1 = share(self.second[w], self.pairs, *self.levels, self.d1, alone & (before == 1))
        return -np.log2(a3 + b3 * (a2 + b2 * (a1 + b1 / self.vocabulary)))


def _answer(row, name: str, numbers: int):
    """A round's answers in the order of the block's trigrams: their counts, and ``numbers`` arrays by context."""
    got = row.column(name).flatten()
    by = np.argsort(got.field("part").to_numpy())
    counts = [_unpack(x, "<u4") for x in got.field("counts").take(pa.array(by)).to_pylist() if x]
    parts = [_unpack(x, "<u4").reshape(numbers, -1) for x in got.field("contexts").take(pa.array(by)).to_pylist()]
    return np.concatenate(counts) if counts else None, np.concatenate(parts, axis=1)


class Models:
    """The languages' models from their packed sums, a few at a time."""

    def __init__(self, sums: dict[str, tuple[bytes, bytes]], vocabulary: int):
        self.sums, self.vocabulary, self.made = sums, vocabulary, {}

    def __getitem__(self, lang: str) -> Language:
        if lang not in self.made:
            if len(self.made) >= LANGUAGES:
                self.made.clear()
            self.made[lang] = Language(*(_unpack(x, "<i8") for x in self.sums[lang]), self.vocabulary)
        return self.made[lang]


def token_bits(row, models: Models, parts: int) -> tuple[_Grams, np.ndarray]:
    """The block of a row with both answers, and the bits of each of its tokens, which are those of its trigram."""
    g = _Grams(row.column("tokens")[0].as_py(), row.column("length").flatten().to_numpy())
    at, context, v, w, pair = g.different(parts)
    (counts, contexts), before = _answer(row, "forward", 4), _answer(row, "backward", 1)[1][0]
    model, bits = models[row.column("lang")[0].as_py()], np.empty(len(v))
    for some in (slice(i, i + SLICE) for i in range(0, len(bits), SLICE)):
        bits[some] = model.bits(v[some], w[some], counts[some].astype(np.int64), contexts[:, context[some]].astype(np.int64), before[pair[some]].astype(np.int64))
    return g, bits[at]


def _score(sent, parts: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                g, bits = token_bits(row, sent.value, parts)
                k = np.maximum(1, g.length // SPAN)
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                edges = np.repeat(g.first, k) + place * np.repeat(g.length, k) // np.repeat(k, k)
                mean = np.add.reduceat(bits, edges) / np.diff(np.concatenate((edges, [len(bits)])))
                texts = np.split(mean, np.cumsum(k)[:-1])
                one = lambda a, t: pa.array([a], pa.list_(t))
                yield pa.RecordBatch.from_arrays([row.column("block"), one([float(np.median(x)) for x in texts], pa.float64()), one([float(x.mean()) for x in texts], pa.float64()), one(k.astype(np.int32), pa.int32())], names=[c.split()[0] for c in SPANS.split(", ")])

    return run


def answered_blocks(docs: DataFrame, rows: str, judge=lambda batches: batches):
    """(blocks, blocks with both answers, models, parts) of what ``judge`` makes of the Arrow batches of ``docs``:
    batches of (lang, text, row), where ``rows`` is row's type.

    Blocks lie in buckets, so that neither join moves them again."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    spark = docs.sparkSession
    size, shuffled = input_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(shuffled, size >> 23), START)
    buckets = max(shuffled, size // BLOCK_BYTES)
    write = _write_blocks(to_arrow_type(DataType.fromDDL(rows)))
    made = docs.mapInArrow(lambda batches: write(judge(batches)), f"block long, lang string, length array<int>, tokens binary, rows array<{rows}>")
    path = new_path(spark, "token-blocks")
    name = f"token_blocks_{path[-32:]}"
    made.write.option("compression", "zstd").option("path", path).bucketBy(int(min(buckets, 100_000)), "block").format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    blocks._stored_at, blocks._stored_as = path, name

    own, sums, tables = blocks.select("block", "lang", "length", "tokens"), [], []
    answered = own
    for backward, label in ((False, "forward"), (True, "backward")):
        asked = own.mapInArrow(_ask(backward, int(parts)), ASKED)
        got = stored(asked.groupBy("lang", "part").applyInArrow(_count(backward), ANSWERED), label)
        tables.append(got)
        sums.append({r["lang"]: r["counts"] for r in got.filter("block = -1").groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect()})  # a row a language
        by = got.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "contexts")).alias(label))
        answered = answered.join(by.hint("shuffle_hash"), "block")
    answered._tables, vocabulary = tables, len(encoder().bytes_of)
    return blocks, answered, Models({lang: (sums[0][lang], sums[1][lang]) for lang in sums[0]}, vocabulary), int(parts)


def span_scores(docs: DataFrame, rows: str, judge) -> tuple[DataFrame, DataFrame]:
    """(blocks, scores): of each block's rows the median and the mean of a token's bits over the spans of ``SPAN``
    tokens or up to twice as many that share all tokens evenly, and the number of spans."""
    blocks, answered, models, parts = answered_blocks(docs, rows, judge)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    scores = stored(answered.mapInArrow(_score(sent, parts), SPANS), "token-scores")
    discard(*answered._tables)
    return blocks, scores
