"""Stupid-backoff scores from n-gram counts of the corpus.

Documents are dealt by content into parts of some MB of text. A part lists its distinct n-grams with their counts, cut by
hash into buckets; a bucket holds one slice of the count table, sums what all parts sent (so that a common n-gram
is one entry from each part, however many documents have it) and is joined back to the parts' n-grams; and each
part then sums its documents' scores. N-grams are 64-bit hashes of words. A document of the corpus is scored by what
the rest of the corpus holds: its own counts are taken off first, as else any text would know itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, each, table

BACKOFF = 0.4
#: Bytes of text in a part, and rows at most, about.
PART, ROWS = 12 << 20, 1 << 16
#: Bytes of text whose n-grams make a bucket, about.
BUCKET = 24 << 20
#: Bytes of words and hashes that a worker remembers, twice.
_REMEMBER = 40_000_000
_START, _TOTAL = np.uint64(1), np.uint64(2)


_words = Recent(_REMEMBER)


def _hash(word: bytes) -> int:
    value = _words.find(word)
    if value is None:
        value = xxhash.xxh64_intdigest(word, 9)
        _words.keep(word, value)
    return value


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return a ^ (a >> np.uint64(27))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, of each word's predecessor (a mark for the first), and of the pairs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    known = list(map(_words.known.get, words))
    if None in known:
        known = [_hash(x) if h is None else h for x, h in zip(words, known)]
    w = np.fromiter(known, np.uint64, len(known))
    before = np.append(_START, w[:-1]) if len(w) else w
    return w, before, _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(w))


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders, sorted, and their counts; _TOTAL counts the words."""
    grams = [ngrams(t) for t in texts]
    n = sum(len(w) for w, _, _ in grams)
    keys, count = np.unique(np.concatenate([x for w, _, pair in grams for x in (w, pair)] or [np.zeros(0, np.uint64)]), return_counts=True)
    more, often = np.array([_START, _TOTAL]), [sum(len(w) > 0 for w, _, _ in grams), n]
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(count, at, often)


def _own(places: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document; scratch has a number for each n-gram of the part."""
    scratch[places] = 0
    np.add.at(scratch, places, 1)
    return scratch[places]


def score_words(w: np.ndarray, pair: np.ndarray, totals: np.ndarray, n_texts: int, n_all: int, scratch: np.ndarray | None) -> np.ndarray:
    """ln S of each word: the share of the pair among its first word's, else BACKOFF times the word's share of all.

    w and pair are the places of a document's words and pairs in totals, the corpus counts; n_texts counts the first
    words, n_all all words. With scratch the document is part of the corpus, and its own counts are taken off. A word
    that the corpus lacks counts as one.
    """
    n_pair, n_word = totals[pair], totals[w]
    n_before = np.append(n_texts, n_word[:-1])
    if scratch is not None:
        own = _own(w, scratch)
        n_pair, n_word, n_before, n_all = n_pair - _own(pair, scratch), n_word - own, n_before - np.append(1, own[:-1]), n_all - len(w)
    alone = BACKOFF * np.maximum(n_word, 1) / max(1, n_all)
    return np.log(np.where((n_pair > 0) & (n_before > 0), n_pair / np.maximum(n_before, 1), alone))


def _pack(a: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what Spark's block compression shortens best."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Bytes of text, and rows."""
    found = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count("*")).first()
    return found[0], found[1]


def _parts(docs: DataFrame, id_col: str, text_col: str, part: int) -> DataFrame:
    """part, doc_id, text: as many parts as the texts' bytes ask for. A row's part depends on its content alone, so that it's the same when a lost task runs again."""
    size, rows = _size(docs, text_col)
    n = max(1, -(-size // part), -(-rows // ROWS))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


ENTRIES = "part long, bucket int, grams binary, counts binary, asks boolean"


def _entries(parts: DataFrame, buckets: int, counted: bool, asks: bool) -> DataFrame:
    """A row for each part and bucket: sorted n-grams, and their counts (zero unless counted)."""

    def of(part: pa.Table) -> pa.Table:
        keys, count = _counts(part["text"].to_pylist())
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        which, at = np.unique(bucket, return_index=True)
        bounds = np.append(at, len(keys))
        count = (count if counted else np.zeros_like(count)).astype("<u4")
        cells = list(zip(bounds[:-1], bounds[1:]))
        return pa.table({
            "part": pa.array([part["part"][0].as_py()] * len(which), pa.int64()), "bucket": pa.array(which.astype(np.int32)),
            "grams": pa.array([_pack(keys[a:b]) for a, b in cells], pa.binary()), "counts": pa.array([_pack(count[a:b]) for a, b in cells], pa.binary()),
            "asks": pa.array([asks] * len(which)),
        })

    return parts.groupBy("part").applyInArrow(of, ENTRIES)


def _answers(entries: DataFrame) -> DataFrame:
    """For each asking entry the corpus counts of its n-grams, in their order: the bucket's count table, joined to what asks."""

    def of(rows: pa.Table) -> pa.Table:
        grams = [_unpack(x, "<u8") for x in rows["grams"].to_pylist()]
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        sent = np.concatenate([_unpack(x, "<u4") for x in rows["counts"].to_pylist()])
        totals = np.bincount(place, sent, minlength=len(keys)).astype("<i8")[place]
        ends = np.cumsum([len(g) for g in grams])
        asks = [i for i, a in enumerate(rows["asks"].to_pylist()) if a]
        at = pa.array(asks, pa.int64())
        packed = [_pack(totals[ends[i] - len(grams[i]) : ends[i]]) for i in asks]
        return pa.table({"part": rows["part"].take(at), "bucket": rows["bucket"].take(at), "totals": pa.array(packed, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(of, "part long, bucket int, totals binary")


def score(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, part: int = PART) -> DataFrame:
    """doc_id, n_words, log_score (the sum of ln S over the words) and mean_log_score of each row of docs.

    The counts are those of corpus, by default docs itself, each document's own left out. Texts without a word, null ones included, score 0.0
    and have a null mean. Repeated rows stay repeated and count each time; other columns are ignored.
    """
    spark = docs.sparkSession
    size = _size(docs if corpus is None else corpus, text_col)[0]
    buckets = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    parts = _parts(docs, id_col, text_col, part)
    within = corpus is None
    entries = _entries(parts, buckets, counted=within, asks=True)
    if corpus is not None:
        entries = entries.unionByName(_entries(_parts(corpus, id_col, text_col, part), buckets, counted=True, asks=False))

    def of(mine: pa.Table, answers: pa.Table) -> pa.Table:
        grams = [ngrams(t) for t in each(mine["text"])]
        n = [len(w) for w, _, _ in grams]
        keys, places = np.unique(np.concatenate([x for w, _, pair in grams for x in (w, pair)]), return_inverse=True)
        del grams
        totals = np.concatenate([_unpack(x, "<i8") for x in answers.sort_by("bucket")["totals"].to_pylist()])
        marks = np.searchsorted(keys, [_START, _TOTAL]) + [0, 1]  # as _counts puts them among the n-grams that were sent
        (n_texts, n_all), totals = totals[marks].tolist(), np.delete(totals, marks)
        scratch = np.zeros(len(keys), np.int64) if within else None
        sums, at = [], 0
        for size in n:
            w, pair = places[at : at + size], places[at + size : at + 2 * size]
            sums.append(float(score_words(w, pair, totals, n_texts, n_all, scratch).sum()) if size else 0.0)
            at += 2 * size
        return pa.table({"doc_id": mine["doc_id"], "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    id_kind = docs.select(id_col).schema[0].dataType.simpleString()
    scored = parts.groupBy("part").cogroup(_answers(entries).groupBy("part")).applyInArrow(of, f"doc_id {id_kind}, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the bigram counts of all other documents, to six decimals, which the order of summing can't change."""
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")])
