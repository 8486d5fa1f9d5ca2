"""SentencePiece encoding and decoding that keeps each piece's place in the original text.

The text is normalised by longest prefixes of the model's compiled character map, recording for each normalised
byte the original byte that it comes from. The normalised text is encoded in slices that end where a word does (no
piece of the model may cross the start of a word; else the whole text is one slice), and the pieces' bounds are
projected through the recorded alignment to byte spans of the original text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each, public_vocabulary, table

MODEL = public_vocabulary("piece_bpe_32k.model")
SPACE = "▁"
#: Characters of normalised text that the library gets at once, about.
_SLICE = 1 << 16


def _fields(message: bytes):
    """(number, value, raw bytes) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        start = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = message[at : at + size], at + size
        yield tag >> 3, value, message[start:at]


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values are places of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that the text has at a place."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Codec:
    """One model's normaliser, pieces and memory of units; made once in each worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.proto = f.read()
        spec = {3: 1, 4: 1, 5: 1, 2: b""} | {n: v for k, x, _ in _fields(self.proto) if k == 3 for n, v, _ in _fields(x)}
        self.map, self.prefix, self.trim, self.escape = CharacterMap(spec[2]), bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        # the same pieces behind a normaliser that leaves text alone
        bare = b"".join(raw for k, _, raw in _fields(self.proto) if k != 3) + b"\x1a\x10" + b"\x0a\x08identity" + b"\x18\0\x20\0\x28\0"
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare)
        pieces = [self.bare.id_to_piece(i) for i in range(self.bare.get_piece_size())]
        self.bytes = np.array([1 if self.bare.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)])
        self.decimal = [str(i) for i in range(len(pieces))].__getitem__
        self.splits = self.escape and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.unknown = self.bare.unk_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte that it comes from."""
        raw = text.encode("utf-8", "replace")
        if self.map.units:
            out, source, at = [], [], 0
            while at < len(raw):
                size, new = self.map.longest(raw, at) or (0, b"")
                if not size:
                    size = 1 + sum(at + k < len(raw) and raw[at + k] >> 6 == 2 and all(raw[at + j] >> 6 == 2 for j in range(1, k)) for k in (1, 2, 3))
                    new = raw[at : at + size]
                out.append(new)
                source += [at] * len(new) if new != raw[at : at + size] else range(at, at + size)
                at += size
            data, align = np.frombuffer(b"".join(out), np.uint8), np.array([*source, len(raw)], np.int64)
        else:
            data, align = np.frombuffer(raw, np.uint8), np.arange(len(raw) + 1)
        if self.trim:  # no spaces at the ends, one between words
            gap = data == 32
            keep = ~gap | np.append(False, ~gap[:-1])
            if len(data) and (last := np.flatnonzero(~gap))[-1:].size:
                keep[last[-1] + 1 :] = False
            elif len(data):
                keep[:] = False
            data, align = data[keep], np.append(align[:-1][keep], align[-1])
        if not len(data):
            return "", np.zeros(1, np.int64)
        if self.prefix:
            data, align = np.append(np.uint8(32), data), np.append(align[0], align)
        if self.escape:
            align = np.repeat(align, np.append(np.where(data == 32, 3, 1), 1))
        normal = data.tobytes().decode("utf-8", "replace")
        return normal.replace(" ", SPACE) if self.escape else normal, align

    def _slices(self, normal: str) -> Iterator[str]:
        """A normalised text cut at starts of words, so that a long one takes no more memory; whole where pieces may cross them."""
        at = 0
        while self.splits and len(normal) - at > _SLICE:
            stop = normal.find(SPACE, at + _SLICE)
            while stop > 0 and normal[stop - 1] == SPACE:  # a run of marks belongs to one word
                stop = normal.find(SPACE, stop + 1)
            if stop < 0:
                break
            yield normal[at:stop]
            at = stop
        yield normal[at:]

    def _pieces(self, part: str) -> tuple[list[int], np.ndarray]:
        """Ids of a slice, and each piece's bytes in it. An unknown piece's aren't in its name, so the library tells them."""
        ids = self.bare.encode(part, add_bos=False, add_eos=False)
        if self.unknown not in ids:
            return ids, self.bytes[ids]
        named = self.bare.encode(part, out_type=str, add_bos=False, add_eos=False)
        return ids, np.array([1 if self.bare.is_byte(i) else len(p.encode()) for i, p in zip(ids, named)])

    def encode(self, text: str | None) -> tuple[list[int], str, np.ndarray]:
        """Ids, their decimal text joined by commas, and the original byte bounds [pieces, 2] of the pieces.

        A piece that stands for one byte of a character gets that byte alone.
        """
        normal, align = self.normalise(text or "")
        if not normal:
            return [], "", np.zeros((0, 2), np.int64)
        ids, sizes = zip(*map(self._pieces, self._slices(normal)))
        ids = list(chain.from_iterable(ids))
        bounds = align[np.append(0, np.concatenate(sizes).cumsum())]
        return ids, ",".join(map(self.decimal, ids)), np.stack([bounds[:-1], bounds[1:]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column, model: str = MODEL) -> Column:
    """struct<ids, starts, ends>: a text column's ids and the byte span of each piece. A null text has no pieces."""

    def of(texts: pa.Array) -> pa.Array:
        one = codec(model)
        ids, spans = [], []
        for text in each(texts):
            i, _, s = one.encode(text)
            ids.append(i)
            spans.append(s)
        lists = [pa.array(ids, pa.list_(pa.int32())), *(pa.array([s[:, k] for s in spans], pa.list_(pa.int64())) for k in (0, 1))]
        return pa.StructArray.from_arrays(lists, ["ids", "starts", "ends"])

    return F.arrow_udf(of, "struct<ids:array<int>,starts:array<bigint>,ends:array<bigint>>")(text)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of id lists; null for null."""

    def of(lists: pa.Array) -> pa.Array:
        one = codec(model)
        return pa.array([None if x is None else one.decode(x) for x in each(lists)], pa.string())

    return F.arrow_udf(of, "string")(ids)


def round_trip(text: Column, model: str = MODEL) -> Column:
    """Digests of what encode and decode give, without carrying the pieces to the JVM."""

    def of(texts: pa.Array) -> pa.Array:
        one, rows = codec(model), []
        for text in each(texts):
            ids, decimal, spans = one.encode(text)
            back = one.decode(ids).encode()
            rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), zlib.crc32(spans.tobytes())))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*rows)) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return F.arrow_udf(of, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_crc32:bigint>")(text)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's pieces; spans_crc32 covers their (start, end) byte spans as int64 pairs.

    Null and empty texts have no pieces; repeated rows stay repeated; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")
