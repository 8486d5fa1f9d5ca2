"""The patient-centred dataset: assembly, counters, order, and the split by caregiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical

SCHEMA_VERSION = "0.2"
CAREGIVER = "caregiver"


def assemble(parsed: DataFrame) -> DataFrame:
    """A row for each patient: file_id, path, error, ids, and the nested record's fields.

    parsed has file_id, path, error, meta (of clinical.title), keywords, visits, scales. Two files whose first ids
    agree give two patients with one patient_id. Rows with an error keep only what identifies them.
    """
    first = F.get("meta.ids", F.lit(0))
    visit = lambda v: F.struct(clinical.visit_id(first, v["visit_no"]).alias("visit_id"), F.struct(F.substring_index("path", "/", -1).alias("source_file"), v["turns"].alias("turns")).alias("dialogue"))
    good = F.col("error").isNull()
    fields = {
        "patient_id": clinical.patient_id(first), "name": F.col("meta.name"), "gender": F.col("meta.gender"), "age": F.col("meta.age"),
        "keywords": F.col("keywords"), "scales": F.col("scales"), "visits": F.transform("visits", visit),
    }
    return parsed.select("file_id", "path", "error", F.col("meta.ids").alias("ids"), *[F.when(good, c).alias(n) for n, c in fields.items()])


def converted(patients: DataFrame) -> DataFrame:
    """The patients of files without an error: a file that failed is no patient."""
    return patients.where(F.col("error").isNull()) if "error" in patients.columns else patients


def _counters() -> list[Column]:
    good = F.col("error").isNull()
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    return [
        F.count("*").alias("total_files"), F.count_if(good).alias("converted_files"), F.count_if(~good).alias("failed_files"),
        F.count_if(some("keywords")).alias("patients_with_keywords"), F.count_if(F.col("gender") != "").alias("patients_with_gender"),
        F.count_if(F.col("age").isNotNull()).alias("patients_with_age"), F.count_if(some("scales")).alias("patients_with_scales"),
        F.coalesce(F.sum(F.size(F.coalesce("visits", F.array()))), F.lit(0)).alias("total_visits"),
    ]


def build_figures(patients: DataFrame, *by: str) -> DataFrame:
    """One row of the build's counters, or one for each value of some columns, without its errors, which are as many as there are: see build_errors."""
    return patients.groupBy(*by).agg(*_counters())


def build_errors(patients: DataFrame) -> DataFrame:
    """file and error of each file that failed."""
    return patients.where(F.col("error").isNotNull()).select(F.col("path").alias("file"), "error")


def build_counts(patients: DataFrame) -> DataFrame:
    """One row of the build's counters; errors lists the files that failed, by path: for a build whose failures one machine can hold."""
    failed = F.when(F.col("error").isNotNull(), F.struct(F.col("path").alias("file"), "error"))
    return patients.agg(*_counters(), F.sort_array(F.collect_list(failed)).alias("errors"))


def in_order(patients: DataFrame) -> DataFrame:
    """By the number of the patient id (0 where it has none), then path."""
    return patients.orderBy(clinical.numeric_suffix(F.col("patient_id")), "path")


def has_role(visits: Column, role: str = CAREGIVER) -> Column:
    """Whether any visit has a turn of a role; false for null visits or turns."""
    some = F.exists(visits, lambda v: F.coalesce(F.exists(v["dialogue"]["turns"], lambda t: F.coalesce(t["role"] == role, F.lit(False))), F.lit(False)))
    return F.coalesce(some, F.lit(False))


def split(patients: DataFrame) -> DataFrame:
    """Adds split: with_caregiver or without_caregiver; every patient is in one of them. Failed files are left out."""
    return converted(patients).withColumn("split", F.when(has_role(F.col("visits")), "with_caregiver").otherwise("without_caregiver"))


def split_counts(divided: DataFrame, source_total: int | None = None, source_converted: int | None = None) -> DataFrame:
    """A row for each split: patients, visits, and the two counters of the source."""
    visits = F.coalesce(F.sum(F.size(F.coalesce("visits", F.array()))), F.lit(0))
    return divided.groupBy("split").agg(F.count("*").alias("total_patients"), visits.alias("total_visits")).select(
        "*", F.lit(source_total).cast("long").alias("source_total_files"), F.lit(source_converted).cast("long").alias("source_converted_files")
    )


def turns_with(turns: DataFrame, key: str, role: str = CAREGIVER) -> DataFrame:
    """The flat form of the split: turns of those keys that have a turn of a role."""
    return turns.join(turns.where(F.col("role") == role).select(key), key, "left_semi")


def turns_without(turns: DataFrame, key: str, role: str = CAREGIVER) -> DataFrame:
    """Turns of those keys that have no turn of a role."""
    return turns.join(turns.where(F.col("role") == role).select(key), key, "left_anti")


#: The nested record of a patient in a document.
RECORD = ("patient_id", "name", "gender", "age", "keywords", "scales", "visits")


def document_head(patients: DataFrame, source_dir: str, split_name: str | None = None, source_total: int = 0, source_converted: int = 0) -> DataFrame:
    """The document with its counters, its lists of errors and patients left empty: one row, however many patients there are."""
    meta = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(True).alias("patient_centered"), F.lit(source_dir).alias("source_dir"), *([F.lit(split_name).alias("split")] if split_name else [])]
    if split_name:
        counts = split_counts(converted(patients).withColumn("split", F.lit(split_name)), source_total, source_converted).drop("split")
        none = patients.sparkSession.createDataFrame([(0, 0, source_total, source_converted)], "total_patients long, total_visits long, source_total_files long, source_converted_files long")
        counts = counts.union(none).orderBy(F.desc("total_patients")).limit(1)  # a split that nobody is in
    else:
        counts = build_figures(patients).withColumn("errors", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>").alias("patients")
    return counts.select(F.to_json(F.struct(F.struct(*meta).alias("dataset_meta"), F.struct(*counts.columns).alias("stats"), empty), {"pretty": "true"}).alias("value"))


def document_pieces(rows: DataFrame, fields: tuple[str, ...], depth: int, *order: Column | str) -> DataFrame:
    """value: each row's fields as an object of a list that is depth levels deep in a document, in order from partition to partition.

    Rows are dealt to partitions by ranges of the order, each of which a task can write by itself.
    """
    text = F.regexp_replace(F.to_json(F.struct(*fields), {"pretty": "true"}), "\n", "\n" + "  " * depth)  # strings hold no line ends as they are
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(text.alias("value"))


def document(patients: DataFrame, source_dir: str, split_name: str | None = None, source_total: int = 0, source_converted: int = 0) -> DataFrame:
    """One row, one JSON document: for export of a dataset that one machine can hold. Null fields are left out.

    source_total, source_converted: the counters of the build that a split was made of; without a split they're counted.
    """
    nested = F.struct(*RECORD)
    ordered = F.struct(clinical.numeric_suffix(F.col("patient_id")).alias("n"), "path", nested.alias("p"))
    good = converted(patients)
    listed = good.agg(F.sort_array(F.collect_list(F.struct(F.col("file_id"), ordered.alias("o")))).alias("x"))
    listed = listed.select(F.transform(F.array_sort(F.transform("x", lambda x: F.struct(x["o"]["n"].alias("n"), x["o"]["path"].alias("path"), x["o"]["p"].alias("p"))), lambda a, b: F.when(a["n"] != b["n"], F.signum(a["n"] - b["n"]).cast("int")).when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)), lambda x: x["p"]).alias("patients"))
    meta = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(True).alias("patient_centered"), F.lit(source_dir).alias("source_dir"), *([F.lit(split_name).alias("split")] if split_name else [])]
    counts = split_counts(good.withColumn("split", F.lit(split_name)), source_total, source_converted).drop("split") if split_name else build_counts(patients)
    stats = counts.select(F.struct("*").alias("stats"))
    return listed.crossJoin(stats).select(F.to_json(F.struct(F.struct(*meta).alias("dataset_meta"), "stats", "patients"), {"pretty": "true"}).alias("value"))
