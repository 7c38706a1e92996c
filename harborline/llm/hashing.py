"""64-bit hashes of words and word n-grams of many texts at once.

Words are runs of bytes other than space and \\t..\\r. Arrow's dictionary encoding leaves each different word
of a batch once, and its two hashes are the halves of the word's XXH3 of 128 bits. The hash of an n-gram is a
polynomial of its words' hashes over odd powers modulo 2**64, taken from prefix sums and then mixed, so
n-grams of any length cost the same.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        root = _ROOTS[which]
        up, down = np.full(size, root, np.uint64), np.full(size, pow(root, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = np.cumprod(up), np.cumprod(down)
    return have


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1, which)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end) of what ``prefix`` was taken over; the length counts."""
    h = (sums[ends] - sums[starts]) * _powers(len(sums), which)[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch of texts: ``starts``/``ends`` in bytes, ``first[d]``: the first word of text d,
    ``inside``: whether each byte is one of a word."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.raw, self.offs = (LOWER[raw] if lower else raw), offs
        n = len(raw)
        self._hashes, self.inside = None, ~SPACE[raw]
        word = self.inside
        begin, end = word.copy(), word.copy()
        if n:
            cut = np.zeros(n + 1, bool)
            cut[offs] = True
            begin[1:] &= ~word[:-1] | cut[1:n]
            end[:-1] &= ~word[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of the two hashes of each word."""
        if self._hashes is None:
            size = self.ends - self.starts
            flat = np.ascontiguousarray(self.raw[self.inside])
            edges = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
            known = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), U).reshape(-1, 2)
            self._hashes = known[np.asarray(words.indices)]
        return np.ascontiguousarray(self._hashes[:, which])

    def positions(self, k: int) -> np.ndarray:
        """Where a k-word window fits into its text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= k)
