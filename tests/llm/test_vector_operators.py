"""Whitening and vector codes against plain NumPy versions, with nulls, ties, repeated and ragged rows."""
import hashlib
import math
import random

import numpy as np
import pytest

from harborline.llm import embedding_whitening as W
from harborline.llm import vector_codes as C
from harborline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, key long"


def rows_of(n, width, seed):
    r = random.Random(seed)
    out = [[i * 3, [float(np.float32(r.gauss(0, 0.3) + (i % 3))) for _ in range(width)], r.choice([1, 2, None])] for i in range(n)]
    out[5][1], out[6][1], out[7][1], out[8][1] = None, [None] + [0.5] * (width - 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1)
    out[9][1] = out[10][1] = out[11][1]  # ties
    return [(*x, "clash", 1, 2) for x in out] + [(30, out[12][1], 2, "again", 1, 2), (30, out[12][1], 2, "again", 1, 2), (None, out[13][1], 1, None, None, None)]


def kept_of(rows, width):
    keep = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [i for i, _, _ in keep], np.array([v + [0.0] * (width - len(v)) for _, v, _ in keep], np.float64), [lab for _, _, lab in keep]


def codes_by_hand(ids, values, parts, entries, rounds):
    x = np.floor(values * 256).astype(np.int64).reshape(len(ids), parts, -1)
    first = {}
    for i, v in sorted((i, v.tolist()) for i, v in zip(ids, x) if i is not None):
        first.setdefault(i, np.array(v))
    books = np.stack([first[i] for i in sorted(first)[:entries]]).transpose(1, 0, 2)
    for r in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(3)
        label = far.argmin(2)
        if r == rounds:
            return books, ["".join(f"{e:02x}" for e in row) for row in label.tolist()], far.min(2).sum(1).tolist()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (label[:, p] == e).any():
                    got = x[label[:, p] == e, p]
                    books[p, e] = [sum(c) // len(got) for c in got.T.tolist()]


@pytest.mark.parametrize("width,parts,entries,leaf,block", [(8, 2, 7, 2, 1 << 20), (12, 4, 20, 4, 4000), (10, 4, 3, 1, 800), (64, 16, 64, 16, 32 << 20)])
def test_codes_equal_those_by_hand(spark, width, parts, entries, leaf, block):
    rows = rows_of(150, width, width)
    rows.append((1000, [1.0, 2.0], 5, None, None, None))  # shorter: ends in zeros
    ids, values, labels = kept_of(rows, -(-width // parts) * parts)
    df, books = C.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), settings=C.Settings(parts=parts, entries=entries, leaf=leaf, block=block))
    assert df.columns == ["vec_id", "label", "part", "key", "code", "error"]
    want, codes, errors = codes_by_hand(ids, values, parts, entries, 2)
    assert (books == want).all()
    got = [(r["vec_id"], r["label"], r["code"], r["error"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(zip(ids, labels, codes, errors), key=str)


def test_filtering_assigns_as_all_distances_do():
    r = np.random.default_rng(3)
    for n, w, k, spread in ((1, 1, 1, 5), (500, 1, 9, 4), (3000, 3, 40, 9), (3000, 2, 64, 1000), (2000, 4, 30, 1 << 25), (700, 5, 3, 0)):
        points = r.integers(-spread, spread + 1, (n, w))
        book = np.concatenate((points[r.integers(0, n, k)], r.integers(-spread, spread + 1, (k, w))))  # with equal entries
        label, sums, counts = C.assign(points, book, 3)
        want = ((points[:, None] - book) ** 2).sum(2).argmin(1)
        assert (label == want).all() and (counts == np.bincount(want, minlength=len(book))).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(len(book)))


def test_whole_subtrees_are_assigned_at_once(monkeypatch):
    r = np.random.default_rng(4)
    book = np.array([[0, 0], [1000, 1000], [0, 1000]])
    points = np.concatenate([b + r.integers(-50, 50, (5000, 2)) for b in book])
    seen = []
    single = C._single
    monkeypatch.setattr(C, "_single", lambda tree, start, end, *rest: (seen.append((end - start).sum()), single(tree, start, end, *rest)))
    C.assign(points, book, 16)
    assert sum(seen) == 0


def test_codes_of_empty_and_null_tables(spark):
    for rows in ([], [(1, None, 1, None, None, None)], [(1, [], 1, None, None, None)], [(None, [1.0], 1, None, None, None)]):
        df, books = C.compress(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns[-2:] == ["code", "error"] and books.size == 0
    with pytest.raises(ValueError):
        C.compress(spark.createDataFrame([], SCHEMA), settings=C.Settings(entries=300))


def test_extreme_components_are_held(spark):
    df, _ = C.compress(spark.createDataFrame([(i, [3e38, -3e38] + [float(i)] * 14, 1, None, None, None) for i in range(70)], SCHEMA))
    assert all(0 <= r["error"] for r in df.collect())


def whitening_by_hand(values, k):
    x = np.floor(values * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [int(d) for d in ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("fan", [1, 1 << 20])
def test_whitening_equals_that_by_hand(spark, monkeypatch, fan):
    monkeypatch.setattr(W, "MERGE", fan)  # pairs of factors, or many at once
    rows = rows_of(200, 10, 1)
    ids, values, _ = kept_of(rows, 10)
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    fit = W.fit_whitening(df, components=4)
    deviation, white, explained = whitening_by_hand(values, 4)
    got = W.whiten(df, fit).collect()
    assert sorted(str((r["vec_id"], int(r["deviation"]))) for r in got) == sorted(str(x) for x in zip(ids, deviation))
    by_id = {r["vec_id"]: np.array(r["whitened"]) for r in got}
    for c in range(4):
        at = [i for i, x in enumerate(ids) if x not in (None, 30)]  # 30 has two vectors
        mine, theirs = np.array([by_id[ids[i]][c] for i in at]), white[at, c]
        assert np.abs(mine - theirs * np.sign((mine * theirs).sum())).max() < 1e-9
    assert np.allclose(fit.explained, explained, rtol=1e-9)
    assert W.identity_error(df, fit) < 1e-9


def test_whitening_of_small_and_extreme_tables(spark):
    make = lambda vs: spark.createDataFrame([(i, v, 1, None, None, None) for i, v in enumerate(vs)], SCHEMA)
    assert W.fit_whitening(make([])) is None and W.fit_whitening(make([None, [None]])) is None and W.fit_whitening(make([[]])) is None
    one = W.fit_whitening(make([[1.0, 2.0]]))
    assert one.explained == [None, None] and W.identity_error(make([[1.0, 2.0]]), one) is None
    assert [(int(r["deviation"]), r["whitened"]) for r in W.whiten(make([[1.0, 2.0]]), one).collect()] == [(0, [None, None])]
    flat = make([[1.0, 2.0], [1.0, 3.0], [1.0, 5.0]])  # no spread in the first dimension
    fit = W.fit_whitening(flat)
    assert fit.explained == [1.0, 0.0] and all(r["whitened"][1] is None for r in W.whiten(flat, fit).collect())
    large = make([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])
    assert all(r["deviation"] > 0 for r in W.whiten(large, W.fit_whitening(large)).collect())


def test_exact_deviations_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [float(i * 1000), -float(i)], 1, None, None, None) for i in range(3000)], SCHEMA)
    want, _, _ = whitening_by_hand(np.array([[i * 1000.0, -float(i)] for i in range(3000)]), 2)
    assert max(want) > 1 << 63
    fit = W.fit_whitening(df)
    assert sorted(int(r["deviation"]) for r in W.whiten(df, fit).collect()) == sorted(want)


def test_registered_vector_queries(spark):
    at = "/root/testdata/sf0.001"
    white = QUERIES["op11_embedding_whitening"](spark, at)
    assert dict(white.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = white.collect()
    source = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    ids, values, labels = kept_of([(r["vec_id"], r["embedding"], r["label"]) for r in source], 64)
    deviation, white, explained = whitening_by_hand(values, 8)
    assert {(r["vec_id"], r["deviation"], r["n"]) for r in rows} == {(i, d, len(ids)) for i, d in zip(ids, deviation)}
    assert len(rows) == 8 * len(ids) and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    assert np.allclose(sorted({r["explained"] for r in rows}, reverse=True), explained, rtol=1e-9)
    place = {i: k for k, i in enumerate(ids)}
    for c in range(8):
        mine = np.array([r["whitened"] for r in sorted(rows, key=lambda r: place[r["vec_id"]]) if r["component"] == c + 1])
        assert np.abs(mine - white[:, c] * np.sign(mine @ white[:, c])).max() < 1e-8

    codes = QUERIES["op12_vector_codes"](spark, at)
    assert dict(codes.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    books, want, errors = codes_by_hand(ids, values, 16, 64, 2)
    total = {}
    for lab, e in zip(labels, errors):
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    assert {tuple(r) for r in codes.collect()} == {(i, c, e, total[lab], digest) for i, c, e, lab in zip(ids, want, errors, labels)}
