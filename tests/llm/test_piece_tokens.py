"""Ids, spans and texts against the library's own, with maps that replace characters as well."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from harborline.llm import piece_tokens as P
from harborline.llm.queries import QUERIES

CASES = ["", " ", "  a b", "a  b \n c ", "<s> x </s> <unk> <0x0A>", "x▁y ▁▁ z▁", "a\x00b\x00", "日本 naïve 😀👩‍👧 é é", "end ", "　wide space", "ﬁ ½ Ⅷ ㌀ ㎏ ｱﾞ ①", "​­", "가ᅡᆨ 각", "x" * 500, "= " * 300, "\t\n\r ", "▁", "� ﻿ a"]
LETTERS = [*"abé ▁\n\t", "  ", "日", "ﬁ", "́", "ｶ", "ﾞ", "가", "ᆨ", "㎏", "😀", "\x00", "　", "the ", "ing"]
LIBRARY = SentencePieceProcessor(model_file=P.model_path())


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def encoded(coder, texts):
    ids, starts, ends, at = coder.encode(pa.array(texts, pa.string()))
    return [(ids[a:z].tolist(), starts[a:z].tolist(), ends[a:z].tolist()) for a, z in zip(at, at[1:])]


def check_spans(texts, found):
    """Spans follow each other to the text's end, and without replaced characters hold what the piece says."""
    for text, (ids, starts, ends) in zip(texts, found):
        raw = (text or "").encode()
        assert starts[1:] == ends[:-1] and (not ids or ends[-1] == len(raw) and starts[0] == 0)
        for k, (i, a, z) in enumerate(zip(ids, starts, ends)):
            name = LIBRARY.id_to_piece(i)
            want = bytes([int(name[3:5], 16)]) if LIBRARY.is_byte(i) else name.encode()
            got = raw[a:z].replace(b" ", P.SPACE.encode())
            assert got == want or k == 0 and P.SPACE.encode() + got == want


def test_ids_and_spans_equal_the_library(rows):
    texts = [r[1] for r in rows] + CASES + random_texts(3000, 1) + [" ".join(random_texts(2000, 2))]
    coder = P.Pieces()
    assert coder.cut
    for _ in range(2):  # anew, and from the cache
        found = encoded(coder, texts)
        assert [x[0] for x in found] == LIBRARY.encode([t or "" for t in texts])
        check_spans(texts, found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_any_text(texts):
    coder = P.pieces()
    found = encoded(coder, texts)
    assert [x[0] for x in found] == [LIBRARY.encode(t) for t in texts]
    check_spans(texts, found)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("in_front,fold,escape", [(True, True, True), (False, False, True), (False, True, False), (True, False, True)])
def test_normalised_texts_and_sources_equal_the_library(rule, in_front, fold, escape):
    library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=in_front, escape_whitespaces=escape, remove_extra_whitespaces=fold)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = in_front, fold, escape
    own, texts = P.Normaliser(spec), CASES + random_texts(1500, 5)
    raw, offs = P.flat_text(pa.array(texts))
    norm, source, at = own(raw, offs)
    for i, t in enumerate(texts):
        want, where = library.normalize(t, with_offsets=True)
        got = norm[at[i] : at[i + 1]].tobytes()
        assert got.decode() == want, t
        spots = [len(t[:k].encode()) for k in where]  # the source of each character of the result, and of its end
        mine = (source[at[i] : at[i + 1]] - offs[i]).tolist()
        heads = [k for k, b in enumerate(got) if b & 0xC0 != 0x80]
        assert [mine[k] for k in heads] == spots[: len(heads)], t


def model_with(rule, kind=2, byte_fallback=True):
    m = sentencepiece_model_pb2.ModelProto()
    with open(P.model_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = True
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, byte_fallback
    if not byte_fallback:
        for p in m.pieces:
            if p.type == p.BYTE:
                p.type = p.UNUSED
    return m


@pytest.mark.parametrize("kind,fallback", [(2, True), (1, True), (2, False)])
def test_models_with_maps_unknown_pieces_and_other_kinds(tmp_path, kind, fallback):
    m = model_with("nmt_nfkc", kind, fallback)
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    coder, library, texts = P.Pieces(str(path)), SentencePieceProcessor(model_file=str(path)), CASES + random_texts(600, 7)
    assert coder.cut == (kind == 2)
    found = encoded(coder, texts)
    assert [x[0] for x in found] == library.encode(texts)
    for t, (ids, starts, ends) in zip(texts, found):
        assert all(a <= z for a, z in zip(starts, ends)) and starts == [*starts[:1], *ends[:-1]] and (not ids or ends[-1] == len(t.encode()))


def test_models_that_are_refused(tmp_path):
    m = model_with("nmt_nfkc")
    m.pieces[500].type = m.pieces[500].USER_DEFINED
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        P.Pieces(str(tmp_path / "u.model"))


def test_rows_keep_keys_and_order_of_pieces(spark, docs, rows, empty):
    got = P.decode_pieces(P.encode_pieces(docs)).collect()
    assert sorted(str((r["doc_id"], r["decoded"])) for r in got) == sorted(str((r[0], LIBRARY.decode(LIBRARY.encode(r[1] or "")))) for r in rows)
    assert P.decode_pieces(P.encode_pieces(empty)).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "ids long, pieces array<int>")
    assert [tuple(r) for r in P.decode_pieces(nulls, ids="pieces", name="text").orderBy("ids").collect()] == [(1, None), (2, "")]


def test_a_very_long_text_in_small_slices(spark, monkeypatch, prose):
    long = prose(60_000, 3) + "z" * 5000
    got = P.encode_pieces(spark.createDataFrame([(1, long), (2, "a"), (3, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {1: LIBRARY.encode(long), 2: LIBRARY.encode("a"), 3: []}


def test_the_cache_gives_way(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    coder, texts = P.Pieces(), random_texts(200, 9)
    for at in range(0, 200, 20):
        assert [x[0] for x in encoded(coder, texts[at : at + 20])] == LIBRARY.encode(texts[at : at + 20])
    assert len(coder.known) < 2000


def test_registered_query(spark):
    got = QUERIES["op13_piece_tokens"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "n_bytes": "bigint"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "")
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else ""), len((r["text"] or "").encode())))
    assert {tuple(r) for r in got.collect()} == want
    assert np.all([r["n_bytes"] >= 0 for r in got.collect()])
