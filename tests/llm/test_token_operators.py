import glob
import bisect
import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborline.llm import best_fit_packing, katz_model, length_histogram, token_files, tokens
from harborline.llm.common import new_path
from harborline.llm.tokens import END_ID, Encoder, vocabulary_path
from tests.llm.conftest import words


def ids_of(texts):
    t = Tokenizer.from_file(vocabulary_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, END_ID], "<u4") for x in texts]


def test_encoder_equals_the_library(rows):
    """White space of all kinds, in and beside words, and the added token; met anew and from the cache."""
    r = random.Random(1)
    letters = [*"ab '1.x\n\t<|>", "  ", "é", "\u3000", "\x85", "\xa0", "\x1c", "<|endoftext|>"]
    texts = [x[1] for x in rows] + [" ", "  a b", "a  b", "don't it's 123abc ,x. <|endoftext|> x", "x y\u3000z", "x\u3000  y", "a \u3000b", "tab\t b\n\n c", "emoji 😀 👩‍👧 a", "é" * 50 + " 's", "\x1c a \x85 b"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want, coder = [x.tolist() for x in ids_of(texts)], Encoder()
    for _ in range(2):
        flat, at = coder.encode(pa.array(texts, pa.string()), END_ID)
        assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == want
        assert (coder.lengths(pa.array(texts, pa.string())) + 1).tolist() == [len(x) for x in want]


def test_encoder_cache_gives_way(monkeypatch, prose):
    monkeypatch.setattr(tokens, "CACHE", 50)
    coder = Encoder()
    for seed in range(5):
        texts = [prose(40, seed), prose(30, seed + 100) + "y" * 200]
        flat, at = coder.encode(pa.array(texts), END_ID)
        assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == [x.tolist() for x in ids_of(texts)]
        assert all(len(k) <= tokens.LONG for k in coder.keys.to_pylist())


def test_token_files_have_row_groups_and_page_indexes(spark, prose, monkeypatch):
    """Several row groups a file, page indexes, delta or dictionary encodings, and reads that skip row groups."""
    monkeypatch.setattr(token_files, "ROW_GROUP", 32 << 10)
    monkeypatch.setattr(token_files, "PAGE", 4 << 10)
    docs = spark.createDataFrame([(i, prose(100, i)) for i in range(2000)], "doc_id long, text string")
    path = new_path(spark, "files")
    token_files.write_token_files(docs, path, partitions=2)
    files = glob.glob(f"{path.removeprefix('file://')}/*.parquet")
    assert len(files) == 2
    for file in files:
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 1
        for c in range(meta.num_columns):
            column = meta.row_group(1).column(c)
            assert column.has_offset_index and column.has_column_index and column.compression == "ZSTD"
            assert any("DICTIONARY" in e or "DELTA" in e for e in column.encodings)
    assert [r[0] for r in token_files.read_token_files(spark, path).filter("doc_id = 150").select("doc_id").collect()] == [150]


def test_repeated_ids_spread_over_files(spark, prose):
    docs = spark.createDataFrame([(7, prose(30, i)) for i in range(400)], "doc_id long, text string")
    path = new_path(spark, "files")
    token_files.write_token_files(docs, path, partitions=4)
    got = token_files.read_token_files(spark, path).select("start", "n_tokens").orderBy("start").collect()
    assert len(glob.glob(f"{path.removeprefix('file://')}/*.parquet")) == 4
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and len(got) == 400


def test_token_files_round_trip(spark, docs, rows, empty):
    path = new_path(spark, "files")
    token_files.write_token_files(docs, path, partitions=3)
    got = token_files.with_crc32(token_files.read_token_files(spark, path)).collect()
    at, want = 0, []
    for (doc, *_), ids in sorted(zip(rows, ids_of(r[1] for r in rows)), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    meta = token_files.read_token_files(spark, path).select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()
    path = new_path(spark, "files")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing_places_every_piece_once(spark, docs, rows, empty):
    capacity = 64
    got = best_fit_packing.pack(docs, capacity).collect()
    ids = {r[0]: x for r, x in zip(rows, ids_of(r[1] for r in rows))}
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, x in ids.items():
        mine = sorted(pieces[doc])
        assert [p[0] for p in mine] == list(range(len(mine))) and sum(p[2] for p in mine) == len(x)
        assert all(p[2] == capacity for p in mine[1:]) and (len(mine) == 1) == (len(x) <= capacity)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(x) for x in ids.values())
    assert len(sequences) <= -(-total // capacity) + 1
    assert best_fit_packing.pack(empty).count() == 0


def test_plan_takes_exact_complements_first():
    got = best_fit_packing.plan({7: 2, 3: 1, 2: 1, 1: 1, 5: 2, 4: 1}, 10)
    assert sum(n for _, n in got) == 4 and sorted(x for took, n in got for x in took * n) == [1, 2, 3, 4, 5, 5, 7, 7]
    assert ((7, 3), 1) in got and ((7, 2, 1), 1) in got and ((5, 5), 1) in got
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 100, 30), rng.integers(1, 50, 30))}
        out = best_fit_packing.plan(counts, 100)
        used = {}
        for took, n in out:
            assert sum(took) <= 100
            for x in took:
                used[x] = used.get(x, 0) + n
        assert used == counts


def _best_fit_decreasing(lengths, capacity):
    """Sequences of plain best-fit decreasing, piece by piece."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n += 1
            gaps.append(capacity)
        gap = gaps.pop(i)
        bisect.insort(gaps, gap - x)
    return n


def test_plan_needs_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(5)
    for capacity in (16, 64, 1024):
        for k in range(40):
            top = capacity + 1 if k % 2 else capacity // 2
            counts = collections.Counter(rng.integers(1, top, rng.integers(1, 400)).tolist())
            plain = best_fit_packing.best_fit(np.array([counts[x] for x in range(capacity + 1)]))
            want = _best_fit_decreasing(counts.elements(), capacity)
            assert sum(n for _, n in plain) == want
            out = best_fit_packing.plan(dict(counts), capacity)
            assert -(-sum(counts.elements()) // capacity) <= sum(n for _, n in out) <= want
            assert all(sum(took) <= capacity for took, _ in out)
            assert collections.Counter({x: sum(took.count(x) * n for took, n in out) for x in counts}) == counts
    assert best_fit_packing.plan({}, 10) == []


def test_context_limits_equal_brute_force(docs, rows, empty):
    lengths = [len(x) - 1 for x in ids_of(r[1] for r in rows)]
    got = {r["context_limit"]: r for r in length_histogram.context_limits(length_histogram.length_histogram(docs)).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r["docs"], r["docs_total"], r["tokens_total"]) == (lengths.count(limit), len(lengths), sum(lengths))
        assert r["docs_over"] == sum(x > limit for x in lengths) and r["tokens_within"] == sum(x for x in lengths if x <= limit)
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths) and r["quantile"] == sum(x <= limit for x in lengths) / len(lengths)
    histogram = length_histogram.length_histogram(docs)
    for r in length_histogram.at_limits(histogram, [0, 1, 64, 777, 10**6]).collect():
        k = r["context_limit"]
        assert tuple(r)[1:] == (sum(x > k for x in lengths), sum(x for x in lengths if x <= k), sum(min(x, k) for x in lengths))
    for r in length_histogram.quantiles(length_histogram.context_limits(histogram), [0.1, 0.5, 0.9, 1.0]).collect():
        assert r["length"] == min(x for x in lengths if sum(y <= x for y in lengths) >= r["share"] * len(lengths))
    nothing = length_histogram.length_histogram(empty)
    assert length_histogram.context_limits(nothing).count() == 0
    assert [tuple(r) for r in length_histogram.at_limits(nothing, [5]).collect()] == [(5, 0, 0, 0)]


def brute_katz(rows, held, k=5, least=1):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[*words((r[1] or "").translate(lower)), None] for r in rows]
    c, pairs, n_texts = {}, {}, 0
    for t, h in zip(texts, held):
        if not h:
            n_texts += 1
            for u, w in zip(["<s>", *t], t):
                c[w] = c.get(w, 0) + 1
                pairs[u, w] = pairs.get((u, w), 0) + 1
    n = sum(c.values())

    def factor(counts):
        of = np.array([sum(v == r for v in counts.values()) for r in range(1, k + 2)])
        return katz_model.good_turing(of, k)

    dw, dp = factor(c), factor(pairs)
    lost = sum((1 - dw[min(v, k + 1)]) * v for v in c.values()) / max(1, n)
    unknown, keep = (lost, 1.0) if lost > 0 else (1 / (n + 1), n / (n + 1))
    word = lambda w: keep * dw[min(c[w], k + 1)] * c[w] / n if w in c else unknown

    def prob(u, w):
        seen = [x for (v, x), m in pairs.items() if v == u and m >= least]
        mass = sum(dp[min(pairs[u, x], k + 1)] * pairs[u, x] for x in seen)
        total = n_texts if u == "<s>" else c.get(u, 0)
        if seen and total - mass < 1e-9:
            total += 1
        if w in seen:
            return dp[min(pairs[u, w], k + 1)] * pairs[u, w] / total
        return word(w) * ((1 - mass / total) / (1 - sum(map(word, seen))) if seen else 1.0)

    scores = [sum(np.log10(prob(u, w)) for u, w in zip(["<s>", *t], t)) for t in texts]
    base = [sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t) for t in texts]
    return [(r[0], bool(h), len(t), sum(w in c for w in t), n, b, s) for r, h, t, b, s in zip(rows, held, texts, base, scores)], prob, c


def test_katz_equals_brute_force_and_sums_to_one(spark, rows, empty):
    some = [r for r in rows if len(r[1] or "") < 5000]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long, block string, node int, held string, words int").repartition(3)
    held = [r[0] is not None and r[0] % 3 == 0 for r in some]
    want, prob, c = brute_katz(some, held)
    got = {r["doc_id"]: r for r in katz_model.katz_scores(df, F.col("doc_id") % 3 == 0).collect()}
    assert len(got) == len(want)
    for doc, h, n, known, train, base, score in want:
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, train)
        assert np.isclose(r["base_score"], base) and np.isclose(r["score"], score)
    for u in ("<s>", "one", next(iter(c))):
        assert np.isclose(sum(prob(u, w) for w in [*c, "never seen"]), 1)
    assert katz_model.katz_scores(empty, F.lit(False)).count() == 0
    assert {r["score"] for r in katz_model.katz_scores(df, F.lit(True)).collect()} == {0.0}
