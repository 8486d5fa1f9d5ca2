"""Writers: tables first, and single documents or mirrored files where others want those."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical
from ..operators import dataset, stats
from . import files, trees


def tables(patients: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The dataset as parquet."""
    patients.write.mode(mode).parquet(path)


def split_tables(divided: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The two parts as parquet, each in a folder of its own."""
    divided.write.mode(mode).partitionBy("split").parquet(path)


def one_document(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row document (dataset.document, or a JSON column named value) as one text file in a folder."""
    document.coalesce(1).write.mode(mode).text(path)


#: What stands between the objects of a list in a document, and how its empty lists look.
_BETWEEN, _EMPTY = ", ", '"%s" : [ ]'
MANIFEST = "manifest.json"


def ordered_document(patients: DataFrame, path: str, source_dir: str, split_name: str | None = None, source_total: int = 0, source_converted: int = 0) -> None:
    """The dataset as one document in parts: byte for byte what dataset.document gives in one row, for any number of patients.

    head holds the document with its lists empty, patients and errors hold the lists' objects in files that tasks
    wrote side by side, in order from file to file, and manifest.json says which bytes of which make the document, in
    order: join_document puts them together, files.document_patients reads the parts as they are. patients is read
    several times, so it had best be a table.
    """
    spark = patients.sparkSession
    head = dataset.document_head(patients, source_dir, split_name, source_total, source_converted)
    head.coalesce(1).write.text(f"{path}/head")
    text = "\n".join(r.value for r in spark.read.text(f"{path}/head").collect())  # one small document
    lists = {"patients": dataset.document_pieces(dataset.converted(patients), dataset.RECORD, 1, clinical.numeric_suffix(F.col("patient_id")), "path")}
    if not split_name:
        lists = {"errors": dataset.document_pieces(dataset.build_errors(patients), ("file", "error"), 2, "file", "error"), **lists}
    manifest: list[dict] = []
    for name, pieces in lists.items():
        pieces.write.option("lineSep", _BETWEEN).text(f"{path}/{name}")
        parts = [{"path": f"{name}/{n}", "bytes": size} for n, size in files.listed(spark, f"{path}/{name}") if size and n.startswith("part-")]
        before, _, text = text.partition(_EMPTY % name)
        if parts:
            parts[-1]["bytes"] -= len(_BETWEEN)  # nothing comes after the last
        manifest += [{"text": before + (_EMPTY % name)[:-1]}, *parts, {"text": "]" if not parts else " ]"}]
    manifest.append({"text": text})
    files.put(spark, f"{path}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False).encode())


def join_document(spark: SparkSession, path: str, out: str) -> None:
    """The parts of ordered_document as one file, copied a buffer at a time in whatever file system they are in."""
    manifest = json.loads(files.get(spark, f"{path}/{MANIFEST}"))
    files.concatenate(spark, [m["text"].encode() if "text" in m else (f"{path}/{m['path']}", m["bytes"]) for m in manifest], out)


def split_documents(patients: DataFrame, path: str, source_dir: str) -> None:
    """The two parts as documents, each with its own label."""
    divided, counts = dataset.split(patients), dataset.build_counts(patients).select("total_files", "converted_files").first()
    for name in ("with_caregiver", "without_caregiver"):
        one_document(dataset.document(divided.where(F.col("split") == name).drop("split"), source_dir, name, *counts), f"{path}/{name}")


def summary_document(summary: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """The summary as one document, with the meaning of its figures, and dataset_meta where meta (one row) is given."""
    full = summary.withColumn("metric_definitions", F.create_map(*[F.lit(x) for pair in stats.DEFINITIONS.items() for x in pair]))
    if meta is not None:
        full = meta.select(F.struct("*").alias("dataset_meta")).crossJoin(full)  # one row each
    one_document(full.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")), path)


#: Bytes that a name in a path may have.
NAME_BYTES = 255


class Collisions(ValueError):
    """Texts that have no place of their own weren't written; report has their paths."""

    def __init__(self, report: str, rows: DataFrame) -> None:
        super().__init__(f"some texts weren't written, as their paths collide or are none: see {report}")
        self.report, self.rows = report, rows


def collisions(texts: DataFrame) -> DataFrame:
    """rel_path, n and error of the paths of rel_path rows that are none (bad_path) or that several rows would write (collision).

    A path is none that is null, names no file below a folder, or has a name too long. Paths alone are grouped, not texts.
    """
    path = F.col("rel_path")
    bad = path.isNull() | path.rlike(r"(^|/)\.{0,2}(/|$)") | F.exists(F.split(path, "/"), lambda x: F.octet_length(x) > NAME_BYTES)
    error = F.when(bad, "bad_path").when(F.col("n") > 1, "collision")
    return texts.groupBy("rel_path").agg(F.count("*").alias("n")).select("rel_path", "n", error.alias("error")).where(F.col("error").isNotNull())


def mirrored(texts: DataFrame) -> DataFrame:
    """rel_path, text and error (null, collision, bad_path) of rel_path, text rows."""
    found = collisions(texts).select(F.col("rel_path").alias("p"), "error")
    return texts.join(found, F.col("rel_path").eqNullSafe(F.col("p")), "left").select("rel_path", "text", "error")


def write_mirrored(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A file for each row of rel_path and text (or binary content), at that path below the given one, its bytes as they are; a null text is empty.

    Texts whose paths collide are all left out, the others are written. Then what was left out is reported as rows,
    in a parquet table at _collisions below the path, and Collisions is raised. mode: errorifexists or overwrite.
    """
    spark = texts.sparkSession
    if mode == "errorifexists" and files.existing(spark, [path]):
        raise FileExistsError(path)
    report = f"{path.rstrip('/')}/{trees.COLLISIONS}"
    content = F.coalesce(F.col("content" if "content" in texts.columns else "text").cast("binary"), F.lit(b""))
    left_out = collisions(texts)
    kept = texts.where(F.col("rel_path").isNotNull()).join(left_out.select("rel_path"), "rel_path", "left_anti")
    trees.write(kept.select("rel_path", content.alias("content")), path, mode == "overwrite")
    left_out.write.mode("overwrite").parquet(report)
    rows = spark.read.schema("rel_path string, n long, error string").parquet(report)
    if not rows.isEmpty():
        raise Collisions(report, rows)
