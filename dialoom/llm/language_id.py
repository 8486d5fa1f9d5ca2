"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a distributed sum of sparse counts; the log-probability matrix (buckets x languages) has a fixed
number of rows and one column for each language, and is broadcast; texts are scored by gathering its rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each, remainder, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: What may be a letter; the few marks and numbers among it are told by isalpha.
_LETTER = re.compile(r"[^\W\d_]+")
#: Characters that are hashed at once, so that a long text takes no more memory.
_PIECE = 1 << 18


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's lower-cased letters, words bounded by a space, piece by piece."""
    letters = f" {_OTHER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(letters.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), _PIECE):
        piece = codes[at : at + _PIECE + max(ORDERS) - 1]
        n = min(_PIECE, len(codes) - at)
        out, key = [], np.zeros(len(piece), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            key = key[: len(piece) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + piece[order - 1 :] + np.uint64(order)
            if order in ORDERS:
                hashed = key[:n]
                out.append(((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
        yield np.concatenate(out)


#: The mean log-probability of n-grams that all buckets hold alike: a text in a learnt language lies far above it.
CHANCE = -math.log(BUCKETS)
#: Languages whose part of the matrix is one broadcast.
SLICE = 256


@dataclass
class Model:
    """log_prob: float32 [BUCKETS, languages], whole or in slices of languages; prior: [languages]."""

    languages: list[str]
    log_prob: np.ndarray | list[np.ndarray]
    prior: np.ndarray
    shared: object = field(default=None, repr=False)

    def rate_text(self, text: str | None) -> tuple[str, float, float]:
        """The likeliest language, its posterior, and the mean log-probability of the text's n-grams in it; (und, 0.0, CHANCE) for a null text, one without a letter or an empty model."""
        if not text or not self.languages or not any(any(map(str.isalpha, m.group())) for m in _LETTER.finditer(text)):
            return UNKNOWN, 0.0, CHANCE
        total, n = self.prior.copy(), 0
        slices = self.log_prob if isinstance(self.log_prob, list) else [self.log_prob]
        for buckets in ngram_buckets(text):
            total += np.concatenate([s[buckets].sum(axis=0, dtype=np.float64) for s in slices])
            n += len(buckets)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum()), float((total[best] - self.prior[best]) / max(n, 1))

    def predict_text(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior."""
        return self.rate_text(text)[:2]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 3_000, smoothing: float = 0.05) -> Model:
    """Learns from a sample of at most about max_rows rows of each language (all, if fewer) that have a text.

    Every language is learnt, however many there are: the matrix has 256 KB for each. The counts are summed in Spark;
    what the driver gets has at most BUCKETS rows for each language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))  # the last: documents
        for batch in batches:
            for text, lang in zip(each(batch.column("text")), each(batch.column("lang"))):
                found[lang][BUCKETS] += 1
                for buckets in ngram_buckets(text):
                    found[lang][:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    share = {r.lang: int((1 << 30) * min(1.0, 0.9 * max_rows / r.n)) if r.n > max_rows else 1 << 30 for r in sizes}
    least = F.create_map(*[F.lit(x) for pair in share.items() for x in pair]) if share else F.create_map(F.lit(""), F.lit(0))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.coalesce(F.try_element_at(least, F.col("lang")), F.lit(0))
    sample = known.where(drawn).select("text", "lang")
    got = sample.mapInArrow(counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    n = np.zeros((BUCKETS + 1, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    n[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams = n[:BUCKETS] + smoothing
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.log(np.maximum(n[BUCKETS], 1) / max(1, n[BUCKETS].sum())))


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred, score, per_gram> of a text column, see Model.rate_text. The matrix, BUCKETS floats for each language, is broadcast in slices of SLICE languages."""
    slices = [spark.sparkContext.broadcast(np.ascontiguousarray(model.log_prob[:, i : i + SLICE])) for i in range(0, len(model.languages), SLICE)]
    shared = spark.sparkContext.broadcast((model.languages, model.prior))

    def of(texts: pa.Array) -> pa.Array:
        languages, prior = shared.value
        scorer = Model(languages, [s.value for s in slices], prior)
        lang, score, per_gram = zip(*map(scorer.rate_text, each(texts))) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per_gram, pa.float64())], ["lang_pred", "score", "per_gram"])

    return F.arrow_udf(of, "struct<lang_pred:string,score:double,per_gram:double>").asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row. Other columns are ignored, whatever their names; null texts are und."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df.select("doc_id", predict(docs.sparkSession, model, F.col("text")).alias("r")).select("doc_id", "r.lang_pred", "r.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
