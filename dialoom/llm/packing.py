"""Packing token pieces into sequences of a fixed capacity by linear grouping.

Pieces of equal length are alike, so the plan is made from the count of each length, at most one for each token
of the capacity however many documents there are: large lengths are rounded up within groups of equal
cardinality, configurations of the few rounded sizes are chosen, actual lengths take their places, and small
pieces then go where they fit best. The plan is a table of runs, and each piece finds its place in it by its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, cut, public_vocabulary, table

VOCABULARY = public_vocabulary("word_bpe_49k.json")
CAPACITY = 4096
END = 1
#: Bytes of words and ids that a worker remembers, twice: those of late and those of before.
REMEMBER = 75_000_000
#: Bytes of text whose words are looked up together; a longer text is a slice of its own.
SLICE = 4 << 20
#: Rows of one length that a task ranks, about.
RANKED = 1_000_000
_MARKS = string.punctuation.encode()


class WordTokenizer:
    """Encodes word by word and remembers the words' ids.

    The vocabulary's own rule lowers case, drops white space and never joins what it separates, so a text's ids
    are those of its words in turn. It takes a run of letters for one word, the marks after it for another, and leaves lower-case
    letters in composed form as they are, so such words go to the merges directly.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.memory = Recent(remember)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.characters = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(1, 128)}
        for i in range(128, 256):  # what the rule writes for each byte, read off characters that hold it
            text = bytes([0xC2 + (i >= 0xC0), 0x80 | i & 0x3F]).decode()
            first, last = byte_level.pre_tokenize_str(text)[0][0]
            self.characters |= {text.encode()[0]: first, text.encode()[1]: last}
        for i in range(0xC2, 0xF5):
            text = bytes([i, 0xA0 if i in (0xE0, 0xF0) else 0x80, *[0x80] * ((i >= 0xE0) + (i >= 0xF0))]).decode("utf-8", "ignore")
            if text:
                self.characters[i] = byte_level.pre_tokenize_str(text)[0][0][0]

    def _core(self, core: bytes) -> bytes | None:
        """The ids of a word of lower-case letters in composed form, which goes to the merges directly; None for any other."""
        if core.isalpha() and core.islower():  # of ASCII alone
            plain = core.decode()
        else:
            text = core.decode()
            if not text.isalpha() or not is_normalized("NFC", text):
                return None
            if text != (low := text.lower()):
                if len(low) != len(text) or "Σ" in text:  # where lower() may differ from the vocabulary's rule
                    return None
                core = low.encode()
            plain = core.decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.merges(plain)]).tobytes()

    def _learn(self, word: bytes) -> bytes:
        """A word's ids. What is remembered of a word with marks at its end is its core, at first, as many words share it."""
        memory = self.memory
        packed = memory.older.get(word)
        if packed is None:
            if word.isalpha() and word.islower():  # the common case first: letters of ASCII
                packed = array("I", [t.id for t in self.merges(word.decode())]).tobytes()
            elif (core := word.rstrip(_MARKS)) == word:
                packed = self._core(word) or self._whole(word)
            elif (ids := memory.find(core)) is not None and core.decode().lower().isalpha():  # İ in lower case ends in a mark, which joins those after it
                packed = ids + self._marks(word[len(core) :])
            elif core and (ids := self._core(core)) is not None:
                memory.keep(core, ids)
                return ids + self._marks(word[len(core) :])
            else:
                packed = self._whole(word)
        memory.keep(word, packed)
        return packed

    def _marks(self, marks: bytes) -> bytes:
        packed = self.memory.find(marks)
        if packed is None:
            packed = self._whole(marks)
            self.memory.keep(marks, packed)
        return packed

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all(pa.array([(text or "").encode("utf-8", "replace").decode()])))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; none for null.

        A slice of the texts asks once for each of its distinct words, and Arrow writes their ids out in the words' places.
        """
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(False)
        slices = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE
        firsts = np.flatnonzero(np.diff(slices, prepend=-1)).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(texts)]):
            part = texts.slice(first, end - first).fill_null("")
            low = pc.if_else(pc.match_substring(part, "<|"), part, pc.ascii_lower(part))  # special tokens are in lower case alone
            words = pc.ascii_split_whitespace(low)
            coded = words.values.dictionary_encode()
            distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(False).tolist()
            ids = list(map(self.memory.known.get, distinct))
            if None in ids:
                learn = self._learn
                ids = [learn(w) if x is None else x for w, x in zip(distinct, ids)]
            _, ends, packed = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
            packed = packed.to_pybytes() if packed else b""
            bounds = np.frombuffer(ends, np.int64)[words.offsets.to_numpy()].tolist()
            yield from (packed[a:b] for a, b in zip(bounds, bounds[1:]))


@lru_cache(maxsize=4)
def tokenizer(path: str, remember: int = REMEMBER) -> WordTokenizer:
    return WordTokenizer(path, remember)


def pieces(text: Column, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False, remember: int = REMEMBER) -> Column:
    """array<struct<piece, start, length, ids_crc32, ids>> of a text column: its ids and id 1, cut at the capacity.

    ids is null unless keep_ids. Null and empty texts give one piece, which is id 1 alone.
    """
    step = 4 * capacity
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    def of(texts: pa.Array) -> pa.Array:
        one, rows = tokenizer(vocabulary, remember), []
        for ids in one.encode_all(texts):
            ids += END.to_bytes(4, "little")
            parts = [(at, ids[at : at + step]) for at in range(0, len(ids), step)]
            rows.append([{"piece": i, "start": at // 4, "length": len(x) // 4, "ids_crc32": zlib.crc32(x), "ids": x if keep_ids else None} for i, (at, x) in enumerate(parts)])
        return pa.array(rows, kind)

    return F.arrow_udf(of, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>")(text)


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, remember: int = REMEMBER) -> DataFrame:
    """A row for each piece of each row of docs; other columns are ignored, whatever their names.

    remember: bytes of words and ids that a worker keeps, twice, which trades its memory for time.
    """
    cols = ["piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)]
    df = docs.select(F.col(id_col).alias("doc_id"), pieces(F.col(text_col), vocabulary, capacity, keep_ids, remember).alias("p"))
    return df.select("doc_id", F.explode("p").alias("p")).select("doc_id", *[f"p.{c}" for c in cols])


def _groups(counts: dict[int, int], n_groups: int) -> list[list[list[int]]]:
    """Lengths in falling order in groups of equal cardinality; a group is a stock of [length, count]."""
    total, groups, room = sum(counts.values()), [], 0
    size = -(-total // n_groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                groups.append([])
                room = size
            take = min(left, room)
            groups[-1].append([length, take])
            left, room = left - take, room - take
    return groups


def _best_configuration(sizes: list[int], counts: list[int], first: int, room: int) -> dict[int, int]:
    """How many of each size, the first included once, fill the room best: a bounded subset sum over bit sets."""
    layers, reach, limit = [], 1, (1 << (room - sizes[first] + 1)) - 1
    for g in range(first, len(sizes)):
        for _ in range(min(counts[g] - (g == first), (room - sizes[first]) // sizes[g])):
            more = (reach | reach << sizes[g]) & limit
            if more == reach:
                break
            layers.append((g, reach))
            reach = more
    used, at = defaultdict(int, {first: 1}), reach.bit_length() - 1
    for g, before in reversed(layers):
        if not before >> at & 1:
            used[g] += 1
            at -= sizes[g]
    return dict(used)


#: Group counts and the lengths, as parts of the capacity, from which pieces count as large. With none of the lengths
#: large the whole plan is best fit in falling order of length, so that no plan is worse than that.
PLANS = ((256, 16), (1024, 16), (1, 1))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan of the fewest sequences that PLANS give, the first on a tie."""
    return min((grouped_plan(counts, capacity, n, capacity // part) for n, part in PLANS), key=lambda runs: (runs[:, 3] + runs[:, 2]).max(initial=0))


def grouped_plan(counts: dict[int, int], capacity: int, n_groups: int, small: int) -> np.ndarray:
    """Runs [length, first rank, number, first sequence, offset]: pieces of a length and of ranks in a row go to
    sequences in a row, all at one offset. The number of runs depends on the lengths there are, not on the pieces."""
    runs: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = defaultdict(int)
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> [(first sequence, number)]

    def place(length: int, number: int, first: int, used: int) -> None:
        runs.append((length, ranks[length], number, first, used))
        ranks[length] += number

    # large pieces
    stock = _groups({k: n for k, n in counts.items() if k > small and n}, n_groups)
    sizes, left = [g[0][0] for g in stock], [sum(n for _, n in g) for g in stock]
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        used = _best_configuration(sizes, left, first, capacity)
        number = min(left[g] // n for g, n in used.items())
        open_runs = [(sequences, number, 0)]
        sequences += number
        for g in sorted(used):
            left[g] -= used[g] * number
            for _ in range(used[g]):
                filled = []
                for start, n, taken in open_runs:  # actual lengths take the places of the rounded ones
                    while n:
                        length, have = stock[g][0]
                        take = min(n, have)
                        place(length, take, start, taken)
                        filled.append((start, take, taken + length))
                        start, n = start + take, n - take
                        stock[g][0][1] -= take
                        if have == take:
                            stock[g].pop(0)
                open_runs = filled
        for start, n, taken in open_runs:
            free[capacity - taken].append((start, n))

    # small pieces: the fullest sequence that they fit in, else a new one
    rooms = sorted(free)
    for length in sorted((k for k, n in counts.items() if k <= small and n), reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                free[capacity].append((sequences, -(-todo // fit)))
                sequences += -(-todo // fit)
                insort(rooms, capacity)
                continue
            room = rooms[at]
            start, n = free[room].pop()
            take = min(n, todo)
            place(length, take, start, capacity - room)
            todo -= take
            if take < n:
                free[room].append((start + take, n - take))
            if not free[room]:
                rooms.pop(at)
            if room - length not in rooms:
                insort(rooms, room - length)
            free[room - length].append((start, take))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(df: DataFrame) -> DataFrame:
    """Adds rank, from 0, among the rows of the same length; df has a column salt, which deals them into parts.

    A length that very many pieces have is ranked in parts by salt, each after the parts before it.
    """
    parts = df.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    rows = df.withColumn("own", F.row_number().over(own))
    return rows.join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "before", "own")


def place(spark: SparkSession, runs: np.ndarray, length: Column, rank: Column) -> Column:
    """struct<sequence_id, offset>. The broadcast plan is bounded by the lengths there can be."""
    shared = spark.sparkContext.broadcast(runs)

    def of(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        r = shared.value
        length, rank = lengths.to_numpy(False), ranks.to_numpy(False)
        at = np.searchsorted((r[:, 0] << 44) + r[:, 1], (length << 44) + rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(r[at, 3] + rank - r[at, 1]), pa.array(r[at, 4])], ["sequence_id", "offset"])

    return F.arrow_udf(of, "struct<sequence_id:bigint,offset:bigint>")(length, rank)


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start and length (1 to capacity each).

    Repeated rows each get a place of their own; an empty table stays empty. salts: parts of a length that are
    ranked apart, more where there are many rows, so that a part has at most about RANKED rows of any length.
    """
    spark = piece_rows.sparkSession
    drawn = cut(piece_rows.withColumn("salt", (F.rand(11) * (1 << 30)).cast("int")), "pieces")
    counts = {r.length: r.n for r in drawn.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    salts = max(salts, -(-max(counts.values(), default=0) // RANKED))
    done = ranked(drawn.withColumn("salt", F.col("salt") % salts)).withColumn("at", place(spark, runs, F.col("length"), F.col("rank")))
    return done.select(*piece_rows.columns, "at.sequence_id", "at.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(tokenise(table(spark, sf_dir, "documents")))
