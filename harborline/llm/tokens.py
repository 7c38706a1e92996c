"""Token ids by a public byte-level vocabulary of the tokenizers library.

Every id comes from the library's plain call on pieces of the texts. A text may be cut before an ASCII
white-space character that follows a character that is none: no token reaches over such a place, and none
before it depends on what comes after. So a batch is cut there, Arrow's dictionary encoding leaves each
different piece once, the library encodes those that this process hasn't met lately, and the ids are taken
back to the places of the pieces.
"""
from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from harborline.llm.common import flat_text

#: Beyond so many pieces the cache keeps those of the batch at hand.
CACHE = 1_000_000
#: Bytes; longer pieces are not kept.
LONG = 64
END_ID = 2
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE_SPACE = _ASCII_SPACE.copy()
_MAYBE_SPACE[0x1C:0x20] = True
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts, dictionary encoded, and the first piece of each text."""
    n = len(raw)
    space = _MAYBE_SPACE[raw]
    if (raw >= 0xC2).any():
        for m in _WIDE_SPACE.finditer(raw):
            space[m.start() : m.end()] = True
    cut = np.zeros(n + 1, bool)
    cut[1:n] = _ASCII_SPACE[raw[1:]] & ~space[:-1]
    cut[offs] = True
    starts = np.flatnonzero(cut[:n])
    edges = np.concatenate((starts, [n])).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces.dictionary_encode(), np.searchsorted(starts, offs)


class Encoder:
    """``keys`` and ``ids``: the pieces that this process has met lately and their ids, in Arrow arrays."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a letter for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.keys, self.ids = pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> pa.ListArray:
        """The ids of different pieces. Those that begin with white space and end with none are encoded end to
        end in one call, and cut apart by the bytes of their tokens."""
        out: list = [None] * len(pieces)
        joins = [_ASCII_SPACE[p[0]] and not _MAYBE_SPACE[p[-1]] and (p[-1] < 128 or not _WIDE_SPACE.search(p)) for p in pieces]
        chain, alone = [i for i, j in enumerate(joins) if j], [i for i, j in enumerate(joins) if not j]
        for at in range(0, len(chain), 10_000):
            some = chain[at : at + 10_000]
            (ids,) = self._call([b"".join(pieces[i] for i in some).decode()])
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[i]) for i in some])) + 1
            begin = 0
            for i, end in zip(some, ends.tolist()):
                out[i] = ids[begin:end]
                begin = end
        for at in range(0, len(alone), 1000):
            some = alone[at : at + 1000]
            for i, ids in zip(some, self._call([pieces[i].decode() for i in some])):
                out[i] = ids
        n = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))

    def _look_up(self, pieces: pa.Array) -> pa.ListArray:
        at = pc.index_in(pieces, value_set=self.keys)
        gaps = pc.is_null(at)
        new = pieces.filter(gaps)
        keys, ids = self.keys, self.ids
        if len(new):
            made = self._encode(new.to_pylist())
            place = np.asarray(at.fill_null(0)).astype(np.int64)
            place[np.asarray(gaps)] = len(keys) + np.arange(len(new))
            keys, ids, at = pa.concat_arrays([keys, new]), pa.concat_arrays([ids, made]), pa.array(place)
        found = ids.take(at)
        if len(keys) > CACHE:  # what is in use now stays
            keys, ids = pieces, found
        if len(new):
            keep = pc.less_equal(pc.binary_length(keys), LONG)
            self.keys, self.ids = (keys, ids) if pc.all(keep).as_py() else (keys.filter(keep), ids.filter(keep))
        return found

    def _parts(self, column: pa.Array) -> tuple[pa.Array, pa.ListArray, np.ndarray]:
        pieces, first = _pieces(*flat_text(column))
        return pieces.indices, self._look_up(pieces.dictionary), first

    def lengths(self, column: pa.Array) -> np.ndarray:
        """How many tokens each text has (null: none)."""
        at, ids, first = self._parts(column)
        n = np.diff(np.asarray(ids.offsets))[np.asarray(at)]
        return np.diff(np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[first])

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (null: none), each followed by ``end`` if given, and where each
        text's begin."""
        at, ids, first = self._parts(column)
        taken = ids.take(at)
        flat, offs = np.asarray(taken.flatten()), np.asarray(taken.offsets).astype(np.int64)[first]
        if end is not None:
            flat = np.insert(flat, offs[1:], end)
            offs = offs + np.arange(len(offs))
        return flat, offs


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: later tasks of a worker use what it has cached."""
    return Encoder(path)
