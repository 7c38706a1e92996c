"""Pieces of a SentencePiece model with the bytes of the text that each stands for, and texts from pieces.

Normalisation is done here, for all texts of a batch at once: at every character the longest prefix that the model's
compiled character map knows is replaced, white space is folded and escaped as the model says, and each
normalised byte keeps the place of its source. The library segments the normalised text with the model's own
scores. A piece's length in normalised bytes then leads back to the bytes of the text.

No piece of a byte-pair model with such a vocabulary reaches over a place before an escaped space that follows another
character, and no merge on one side depends on the other. So normalised texts are cut there, and the library
segments each different part once. Other models get whole texts.
"""
from __future__ import annotations

import array
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import documents, flat_text, prepare, slices
from harborline.llm.registry import query

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Beyond so many parts the cache starts anew; longer parts (bytes) are not kept.
CACHE, LONG = 200_000, 64
#: Bytes of text that are normalised at once; a longer text stays whole.
SLICE = 1 << 18
SPACE = "▁"
_ESCAPED = np.frombuffer(SPACE.encode(), np.uint8)


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled map: a trie of 32-bit units in a double array, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).astype(np.int64)
        self.texts = np.frombuffer(blob, np.uint8, offset=4 + n)
        self.ends = np.flatnonzero(self.texts == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit >> 6) & 8)

    def longest(self, raw: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``starts`` how many bytes the longest known prefix has (0: none is known), and where its
        replacement begins. All starts walk down the trie together; no prefix leaves its text."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        last = np.zeros(len(raw) + 1, bool)
        last[offs] = True
        walker, node = np.arange(len(starts)), np.full(len(starts), int(self._offset(self.units[:1])[0]))
        at = starts.copy()
        while len(walker):
            node = node ^ raw[at]
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            go = (node < len(self.units)) & ((unit & 0x800000FF) == raw[at])
            walker, node, unit, at = walker[go], node[go], unit[go], at[go] + 1
            node = node ^ self._offset(unit)
            known = ((unit >> 8) & 1) == 1
            length[walker[known]] = at[known] - starts[walker[known]]
            value[walker[known]] = self.units[node[known]] & 0x7FFFFFFF
            go = ~last[at]
            walker, node, at = walker[go], node[go], at[go]
        return length, value


class Normaliser:
    """The model's rules for texts: character map, extra white space, a space in front, escaped spaces."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.in_front, self.fold, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def _mapped(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and the source byte of each."""
        if self.map is None:
            return raw, np.arange(len(raw), dtype=np.int32)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        length, value = self.map.longest(raw, offs, starts)
        size = np.diff(np.append(starts, len(raw)))
        free = 0
        for i in np.flatnonzero(length > size).tolist():  # prefixes of several characters take these from each other
            if starts[i] < free:
                length[i] = 0
            else:
                free = starts[i] + length[i]
        width = np.ones(len(raw), np.int64)
        hit = np.flatnonzero(length > 0)
        covered = np.zeros(len(raw) + 1, np.int64)
        several = hit[length[hit] > size[hit]]
        np.add.at(covered, starts[several] + 1, 1)
        np.add.at(covered, starts[several] + length[several], -1)
        hit = hit[np.cumsum(covered)[starts[hit]] == 0]
        np.add.at(covered, starts[hit] + 1, 1)
        np.add.at(covered, starts[hit] + length[hit], -1)
        width[np.cumsum(covered)[:-1] > 0] = 0
        width[starts[hit]] = self.map.ends[np.searchsorted(self.map.ends, value[hit])] - value[hit]
        text = np.full(len(raw), -1)
        text[starts[hit]] = value[hit]
        source = np.repeat(np.arange(len(raw)), width)
        inside = np.arange(len(source)) - (np.cumsum(width) - width)[source]
        return np.where(text[source] >= 0, self.map.texts[np.minimum(text[source] + inside, len(self.map.texts) - 1)], raw[source]), source.astype(np.int32)

    def __call__(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts end to end, the source byte of each, and where each text begins in them.

        The source of a text's end is the end of its last character that isn't dropped white space.
        """
        out, source = self._mapped(raw, offs)
        at = np.searchsorted(source, offs).astype(np.int64)
        space = out == 32
        if self.fold:
            before = np.ones(len(out), bool)
            before[1:] = space[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            before[first] = True
            keep = ~(space & before)
            kept = np.concatenate(([0], np.cumsum(keep)))
            last = kept[at[1:]] - 1  # the last byte that a text keeps, if any; a space there goes as well
            which = np.flatnonzero(keep)
            ends = which[last[kept[at[1:]] > kept[at[:-1]]]]
            keep[ends[space[ends]]] = False
            out, source, space = out[keep], source[keep], space[keep]
            at = np.concatenate(([0], np.cumsum(keep)))[at]
        grow = np.where(space, 3, 1) if self.escape else np.ones(len(out), np.int64)
        if self.in_front:
            has = at[:-1] < at[1:]
            mark = 3 if self.escape else 1
            grow[at[:-1][has]] += mark
        begin = np.cumsum(grow) - grow
        made, place = np.repeat(out, grow), np.repeat(source, grow)
        if self.escape:
            spaces = begin + grow - 3
            for k in range(3):
                made[spaces[space] + k] = _ESCAPED[k]
        if self.in_front:
            heads = begin[at[:-1][has]]
            for k in range(mark):
                made[heads + k] = _ESCAPED[k] if self.escape else 32
        at = np.append(begin, len(made))[at]
        if self.fold and self.escape:  # marks at the end go, also those that the text itself has
            keep = np.ones(len(made), bool)
            for a, z in zip(at.tolist(), at[1:].tolist()):
                while z - a >= 3 and (made[z - 3 : z] == _ESCAPED).all():
                    keep[z - 3 : z] = False
                    z -= 3
            made, place, at = made[keep], place[keep], np.concatenate(([0], np.cumsum(keep)))[at]
        return made, place, at


class Pieces:
    """A model in this process: its normaliser, its pieces' lengths, and what it has segmented lately."""

    def __init__(self, path: str | None = None):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path or model_path(), "rb") as f:
            model.ParseFromString(f.read())
        if any(p.type == p.USER_DEFINED for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined pieces or spaces as suffixes are not supported")
        self.normalise = Normaliser(model.normalizer_spec)
        names = [p.piece for p in model.pieces]
        crossing = any(SPACE in n.lstrip(SPACE) for n, p in zip(names, model.pieces) if p.type == p.NORMAL)
        self.cut = model.trainer_spec.model_type == model.trainer_spec.BPE and model.normalizer_spec.escape_whitespaces and SPACE in names and not crossing
        self.bytes_of = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN)
        spec = model.normalizer_spec  # the library then takes normalised text as it is
        spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", b"", False, False, False
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[bytes, bytes] = {}

    def _segment(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part, as bytes of 32-bit integers."""
        return [array.array("i", ids).tobytes() for ids in self.library.encode([p.decode() for p in parts], num_threads=1)]

    def _sizes(self, ids: np.ndarray, edges: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """The bytes of each piece; part p's ids are those from edges[p] to edges[p + 1]. An unknown piece is as long as
        what wasn't known."""
        sizes = self.bytes_of[ids]
        for p in np.unique(np.searchsorted(edges, np.flatnonzero(ids == self.unknown), "right") - 1).tolist():
            sizes[edges[p] : edges[p + 1]] = [len(x.surface.encode()) for x in self.library.encode(parts[p].decode(), return_type="proto").pieces]
        return sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end (null: none), the first and last byte (exclusive) of each within its text, and
        where each text's ids begin."""
        raw, offs = flat_text(column)
        norm, source, at = self.normalise(raw, offs)
        n = len(norm)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        if self.cut and n > 2:
            mark = np.zeros(n + 1, bool)
            mark[: n - 2] = (norm[:-2] == _ESCAPED[0]) & (norm[1:-1] == _ESCAPED[1]) & (norm[2:] == _ESCAPED[2])
            before = np.zeros(n + 1, bool)
            before[3:] = mark[:-3]
            edge |= mark & ~before
        starts = np.flatnonzero(edge[:n])
        cuts = np.append(starts, n).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(norm))]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        new = [p for p in names if p not in self.known]
        fresh = dict(zip(new, self._segment(new)))
        found = [fresh[p] if p in fresh else self.known[p] for p in names]
        if len(self.known) + len(fresh) > CACHE:
            self.known = {}
        self.known.update((p, x) for p, x in fresh.items() if len(p) <= LONG)
        flat = np.frombuffer(b"".join(found), np.int32)
        edges, index = np.cumsum([0, *(len(x) // 4 for x in found)]), np.asarray(parts.indices)
        count = np.diff(edges)[index]
        first = np.cumsum(count) - count
        take = np.repeat(edges[index] - first, count) + np.arange(int(count.sum()))
        ids, ends = flat[take], np.cumsum(self._sizes(flat, edges, names)[take])
        ids_at = np.append(first, len(ids))[np.searchsorted(starts, at)]
        return ids, *self._spans(ends, ids_at, norm, source, at, raw, offs), ids_at

    @staticmethod
    def _spans(ends, ids_at, norm, source, at, raw, offs) -> tuple[np.ndarray, np.ndarray]:
        """Piece spans in normalised bytes as bytes of the sources: from the source of the first byte to that of the byte behind the last."""
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        text = np.repeat(np.arange(len(offs) - 1), np.diff(ids_at))
        after = np.append(source, 0)[np.minimum(ends, len(source))] if len(source) else ends
        behind = ends == at[1:][text]  # the last piece of a text ends with it
        place = np.where(behind, offs[1:][text], after)
        return (source[begins] if len(ends) else begins) - offs[:-1][text], place - offs[:-1][text]


@functools.lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    """The model of this process: later tasks of a worker use what it has cached."""
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str | None = None):
    """The library's model as it is, for texts from ids."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path or model_path())


def encode_pieces(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ids array<int>, starts array<int>, ends array<int>) of every row.

    ``ids`` are those of the library's encode on the whole text, without begin and end; piece i stands for the bytes
    ``starts[i]`` to ``ends[i]`` (exclusive) of the UTF-8 text. Spans follow each other without gaps to the text's end:
    a space that the model puts in front has no bytes, dropped white space belongs to the piece before it (to the first one at
    the text's begin), and all pieces of a character that the map replaces by several begin at that character.
    A null or empty text has no pieces. Rows with a null key and repeated rows stay; other columns are left
    out. A text of any length is encoded whole. ``model`` is a path that every executor can read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, whole.schema.names[1], SLICE):
                ids, starts, ends, at = pieces(model).encode(b.column(1))
                at = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["key", "ids", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("key", key)


def decode_pieces(rows: DataFrame, model: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the library's text for the column ``ids`` in place of it, as ``name``; null ids give null."""
    others = [c for c in rows.columns if c not in (ids, name)]

    def run(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            valid = np.asarray(lists.is_valid())
            flat, edges = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            texts = [decoder(model).decode(flat[a:z].tolist()) if ok and z > a else "" if ok else None for ok, a, z in zip(valid, edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*others, name])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.select(*others, ids).mapInArrow(run, f"{fields}`{name}` string")


@query("op13_piece_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(documents(spark, sf_dir))
    digests = encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"), "ids",
    )
    return decode_pieces(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")
