"""A corpus from raw documents: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import language_id, packing, pii, quality_classifier, simhash
from dialoom.llm.common import bound_batches, cut, remainder, table

#: The least posterior of a document's language.
LEAST_LANGUAGE = 0.5
#: The least quality score; clean documents score far above it.
LEAST_QUALITY = 0.5
#: Bytes that a worker's tokenizer remembers: fewer than by default, as workers keep what earlier stages remember.
REMEMBER = 40_000_000


def _row(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of docs out of a struct named row, whatever their names."""
    return [instead.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows, and gives lang where it was null.

    Rejected are null texts, those without a letter, those that no language is likelier for than all others together,
    and those whose n-grams are less likely in their language than chance. Rows with a null doc_id aren't learnt from
    but judged like others, repeated rows each for themselves; of equally likely languages the first by name counts.
    """
    bound_batches(spark)
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = docs.select(F.struct("*").alias("row"), language_id.predict(spark, model, F.col("text")).alias("found"))
    known = found.where((F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE) & (F.col("found.per_gram") >= language_id.CHANCE))
    return known.select(_row(docs, lang=F.coalesce("row.lang", "found.lang_pred")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of sufficient quality score.

    A null text scores as an empty one. Rows with a null doc_id have no label to learn from but are judged like others,
    repeated rows each for themselves; a score of just LEAST_QUALITY is kept.
    """
    weights = quality_classifier.fit(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    return docs.where(quality_classifier.score(spark, weights, F.col("text")) >= LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that with the smallest doc_id, null ids last, then by a hash of the text.

    Rows of one doc_id, or without one, are told apart by their texts, so that unlike texts each stay.
    """
    # one key without nulls for both steps, so that whole rows are shuffled once; its order is that of survival
    mark = {"__hash": F.xxhash64("text"), "__hash2": F.hash("text")}
    first = F.struct(F.col("doc_id").isNull().alias("__null"), "doc_id", *mark)
    found = simhash.near_groups(docs, **mark).groupBy("root").agg(F.min(first).alias("first")).select("first.*")
    key = {"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__null": F.col("doc_id").isNull()}
    keep = found.select(*[c.alias(n) for n, c in key.items()], *mark)
    key |= mark
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in key.items()])
    return rows.join(keep, list(key), "left_semi").dropDuplicates(list(key)).select(_row(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters anew."""
    text = docs.withColumn("text", pii.redact(F.col("text")))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the training sequences."""
    return packing.pack(packing.tokenise(docs, remember=REMEMBER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]
#: The models and the packing can't be written in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
