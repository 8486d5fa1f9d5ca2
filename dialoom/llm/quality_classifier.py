"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A word gives its lower-cased core, the run of marks around it and its case; pairs of neighbouring words give
bigrams, and a word that repeats the one before it a mark of its own. Feature values are shares of the
document's words, so a score is the mean of the weights that the words select: a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, each, remainder, table

BITS = 18
_CORE = re.compile(r"\w(?:.*\w)?", re.S)
_SAME, _UPPER, _FEW = 1, 2, 3
#: Words that are looked up at once, so that a long text takes no more memory.
_PIECE = 1 << 17
#: Words that a worker remembers the features of, and the characters of the longest that it does.
_REMEMBER, _LONGEST = 100_000, 64


class _Words(dict):
    """word -> core bucket | marks bucket << 20 | upper << 40; forgets all when full, and long words at once."""

    def __missing__(self, word: str) -> int:
        found = _CORE.search(word)
        core, marks = (found.group(), word[: found.start()] + " " + word[found.end() :]) if found else ("", word)
        bucket = lambda kind, x: 4 + xxhash.xxh64_intdigest(f"{kind}{x}".encode("utf-8", "replace")) % ((1 << BITS) - 4)
        value = bucket("w", core.lower()) | (bucket("m", marks) if marks.strip() else 0) << 20 | (len(core) > 1 and core.isupper()) << 40
        if len(word) <= _LONGEST:
            if len(self) >= _REMEMBER:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the text's features, repeats included, piece by piece; bucket 0 is the bias and comes once."""
    words = (text or "").split()
    yield np.zeros(1, np.int64)
    if len(words) < 20:
        yield np.full(1, _FEW)
    for at in range(0, len(words), _PIECE):
        piece = words[at : at + _PIECE + 1]  # with the next piece's first word, for the bigram across
        packed = np.fromiter(map(_words.__getitem__, piece), np.int64, len(piece))
        core = packed & 0xFFFFF
        mine = packed[:_PIECE]
        marks = mine >> 20 & 0xFFFFF
        pair = 4 + (core[:-1] * 0x9E3779B1 + core[1:] * 0x85EBCA77 >> 7) % ((1 << BITS) - 4)
        yield np.concatenate([mine & 0xFFFFF, marks[marks > 0], np.full(int((mine >> 40).sum()), _UPPER), np.where(core[:-1] == core[1:], _SAME, pair)])


def score_text(weights: np.ndarray, text: str | None) -> float:
    """The probability of label 1."""
    parts = features(text)
    bias, total, n = weights[next(parts)[0]], 0.0, max(1, len((text or "").split()))
    for buckets in parts:
        total += float(weights[buckets].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(bias + total / n, -30, 30))))


def train(texts: list[str | None], labels: list[int], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """FTRL-proximal weights of the given rows, in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = []
    for text in texts:
        at, count = np.unique(np.concatenate(list(features(text))), return_counts=True)
        x = count / max(1, len((text or "").split()))
        x[0] = 1.0  # the bias
        rows.append((at.astype(np.int32), x))
    weight = lambda at: np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weight(np.arange(1 << BITS)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8_000, shard: int = 2_000, epochs: int = 12) -> np.ndarray:
    """Trains on a sample of at most about max_rows labels of 0 or 1 (all, if fewer), with their documents' texts.

    Only the sampled labels, whose number is bounded, are broadcast to the texts; rows that are repeated whole count
    once, and of ids with many texts a sample of max_rows rows is taken again. Rows are dealt to shards of about
    shard rows, each is trained in its own task, and the weights averaged: as few as that, since an average of models
    of few rows each is pulled towards the commoner label. The driver gets one weight vector from each shard. No label
    at all: weights of zero.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(bounded_sample(known, F.col("doc_id"), max_rows)), "doc_id").distinct()
    rows = bounded_sample(cut(found, "labelled"), F.xxhash64("doc_id", "text"), max_rows)
    shards = max(1, -(-rows.count() // shard))

    def one(part: pa.Table) -> pa.Table:
        order = part.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])
        mixed = order.take(np.random.default_rng(7).permutation(len(order)))
        return pa.table({"w": [train(mixed["text"].to_pylist(), mixed["y"].to_pylist(), epochs).tobytes()], "n": [len(mixed)]})

    got = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).groupBy("shard").applyInArrow(one, "w binary, n long").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32)
    return (sum(np.frombuffer(r.w, np.float32) * r.n for r in got) / sum(r.n for r in got)).astype(np.float32)


def score(spark: SparkSession, weights: np.ndarray, text: Column) -> Column:
    """The probability of label 1 for a text column. The broadcast is 2 ** BITS floats, whatever the data."""
    shared = spark.sparkContext.broadcast(weights)

    def of(texts: pa.Array) -> pa.Array:
        w = shared.value
        return pa.array([score_text(w, t) for t in each(texts)], pa.float64())

    return F.arrow_udf(of, "double").asNondeterministic()(text)


def classify(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted (score >= 0.5) of each row.

    Null and empty texts score by the bias alone; other columns are ignored, whatever their names.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = df.select("doc_id", score(docs.sparkSession, weights, F.col("text")).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: crc32(id as text) mod 3 is not 1."""
    return labels.where(remainder(F.col(id_col), 3) != 1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labels of documents whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return classify(docs, weights).select("doc_id", held, "score", "predicted")
