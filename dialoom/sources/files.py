"""Readers of dialogue files, photos, score sheets and dataset documents."""

from __future__ import annotations

import json
import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trees, workbooks

_TURN = "struct<role:string,text:string,speaker_note:string>"
_SCALE = "struct<items:array<int>,total:int>"
PATIENT = f"struct<patient_id:string,name:string,gender:string,age:int,keywords:array<string>,scales:array<struct<respondent_role:string,`GAD-7`:{_SCALE},`PHQ-9`:{_SCALE}>>,visits:array<struct<visit_id:string,dialogue:struct<source_file:string,turns:array<{_TURN}>>>>>"
DATASET = f"dataset_meta struct<schema_version:string,patient_centered:boolean,source_dir:string,split:string>, stats struct<total_files:bigint,converted_files:bigint>, patients array<{PATIENT}>"


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _binary(spark: SparkSession, folders: list[str], pattern: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    return reader.load(folders).select("path", "content").withColumn("name", _base(F.col("path")))


def _mounted(paths: list[str]) -> bool:
    return all(p.startswith(("/", "file:")) for p in paths)


def existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """The folders that exist, in whatever file system their paths name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [(f, jvm.org.apache.hadoop.fs.Path(f)) for f in folders]
    return [f for f, p in paths if p.getFileSystem(conf).exists(p)]


def text_files(spark: SparkSession, folders: str | list[str], recursive: bool = True, in_order: bool | None = None) -> DataFrame:
    """file_id, path, folder, name, stem, text, error of each *.txt. Folders that are missing are skipped.

    file_id is a hash of the path. Line ends become \\n; bytes that aren't UTF-8 give a null text and bad_utf8.
    in_order: rows come in the order of paths, in partitions of even bytes, from the format file_tree; else from Spark's
    own reader, which knows more file systems, but no order, and gives no row for an empty file. Unless it's said, folders
    that are local or mounted come in order.
    """
    found = existing(spark, [folders] if isinstance(folders, str) else folders)
    kind = "file_id long, path string, folder string, name string, stem string, text string, error string"
    if not found:
        return spark.createDataFrame([], kind)
    if _mounted(found) if in_order is None else in_order:
        raw = trees.read(spark, found, "*.txt", recursive=recursive).withColumn("name", _base(F.col("path")))
    else:
        raw = _binary(spark, found, "*.txt", recursive)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    return raw.select(
        F.xxhash64("path").alias("file_id"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "name",
        F.regexp_replace("name", r"\.txt$", "").alias("stem"), F.when(good, text).alias("text"), F.when(~good, "bad_utf8").alias("error"),
    )


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Name and size of the files directly in a folder, by name, in whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted((f.getPath().getName(), f.getLen()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver."""
    concatenate(spark, [content], path)


def get(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def concatenate(spark: SparkSession, parts: list[bytes | tuple[str, int]], out: str) -> None:
    """One file of bytes and of the first bytes of files (path, how many), copied a buffer at a time."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(out)
    to = at.getFileSystem(conf).create(at, False)
    try:
        for part in parts:
            if isinstance(part, bytes):
                to.write(part)
            else:
                source = hadoop.fs.Path(part[0])
                content = spark._jvm.org.apache.commons.io.input.BoundedInputStream(source.getFileSystem(conf).open(source), part[1])
                hadoop.io.IOUtils.copyBytes(content, to, 1 << 16, False)
                content.close()
    finally:
        to.close()


def within(path: Column, folders: list[str]) -> Column:
    """A path as it is within the folder that all the given ones are in, or are."""
    plain = [re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", f).rstrip("/") for f in folders]
    top = posixpath.commonpath([posixpath.abspath(p) for p in plain]).rstrip("/")
    return F.substring(path, F.instr(path, f"{top}/") + len(top) + 1, F.length(path))


def numbered(rows: DataFrame, name: str = "nth") -> DataFrame:
    """rows with their numbers from 1 in the order of partitions and of rows within them, which stay where they are.

    Only the partitions' counts meet in one place. The order must be the same when rows are read again, as it is for files.
    """
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each partition
    at = F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1
    return placed.join(starts, part == F.col("__part")).withColumn(name, at).drop("__at", "__part", "__before")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, content of the photos directly in a folder."""
    raw = _binary(spark, [folder], "*", False).where(F.lower("name").rlike(r"\.(jpg|jpeg|png|bmp)$"))
    return raw.select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "content")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A score sheet: parquet, csv with a header, or a workbook (xlsx, or a folder of them named so); all strings but in parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm"):
        return workbooks.read(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dataset document: dataset_meta, stats, patients."""
    return spark.read.schema(DATASET).option("multiLine", "true").json(path)


def patients_of(documents: DataFrame) -> DataFrame:
    """The patients of dataset documents, with the columns that the operators expect."""
    flat = documents.select(F.inline(F.coalesce("patients", F.array().cast(f"array<{PATIENT}>"))))
    source = F.get(F.col("visits"), F.lit(0))["dialogue"]["source_file"]
    return flat.select(F.xxhash64("patient_id", source).alias("file_id"), source.alias("path"), F.lit(None).cast("string").alias("error"), "*")


def document_patients(spark: SparkSession, path: str) -> DataFrame:
    """The patients of a document in parts (sinks.ordered_document), each part read where it is, with the columns of patients_of. A part is as long as a task wrote it."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(f"{path}/patients").where("length > 0")
    listed = F.concat(F.lit("["), F.regexp_replace(F.col("content").cast("string"), ", $", ""), F.lit("]"))
    return patients_of(raw.select(F.from_json(listed, f"array<{PATIENT}>").alias("patients")))


def document_meta(spark: SparkSession, path: str) -> DataFrame:
    """meta_of a document in parts."""
    return meta_of(dataset(spark, f"{path}/head"))


def _mistyped(value, kind: T.DataType, at: str = "$") -> str | None:  # noqa: ANN001
    """The path of the first value that isn't of its type; null fits any."""
    if value is None or isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return at
        return next((p for f in kind if f.name in value and (p := _mistyped(value[f.name], f.dataType, f"{at}.{f.name}"))), None)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return at
        return next((p for i, x in enumerate(value) if (p := _mistyped(x, kind.elementType, f"{at}[{i}]"))), None)
    fits = isinstance(value, bool) if isinstance(kind, T.BooleanType) else isinstance(value, int) and not isinstance(value, bool)
    return None if fits else at


def _fault(content: bytes, kind: T.StructType) -> tuple[str, str | None]:
    """What is wrong with a document, and where."""
    try:
        text = content.decode()
        if not text.strip():
            return "empty_document", None
        place = _mistyped(json.loads(text), kind)
    except UnicodeDecodeError as error:
        return "malformed_json", f"byte {error.start}"
    except json.JSONDecodeError as error:
        return "malformed_json", f"{error.lineno}:{error.colno}"
    return ("wrong_type", place) if place else ("malformed_json", None)


def checked(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """The dataset documents below a folder, or the one at a path (path and the columns of dataset), and a table of what is none: path, error and place.

    Errors: empty_document; malformed_json, with line:column or byte; wrong_type, with the JSON path of the first value
    that isn't of its type. A document is read permissively, one with an error is in the table alone, and nothing ends a
    job. What was read stays beside the record that could not be, so only such a document is looked at again for the place.
    """
    kind = T.StructType.fromDDL(DATASET)
    if _mounted([path]):
        raw = trees.read(spark, path, glob).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).select("path", "content")
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    text = F.col("content").cast("string")
    rows = raw.withColumns({"d": F.from_json(text, T.StructType([*kind, T.StructField("_bad", T.StringType())]), options), "object": F.ltrim(text, F.lit(" \t\r\n")).startswith("{")})
    bad = ~F.col("object") | F.col("d").isNull() | F.col("d._bad").isNotNull() | ~F.is_valid_utf8(text)

    def faults(contents: pa.Array) -> pa.Array:
        found = [_fault(c.as_py(), kind) for c in contents]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], ["error", "place"])

    fault = F.arrow_udf(faults, "struct<error:string,place:string>")(F.col("content"))
    return rows.where(~bad).select("path", *[f"d.{f.name}" for f in kind]), rows.where(bad).select("path", fault.alias("f")).select("path", "f.*")


def meta_of(documents: DataFrame) -> DataFrame:
    """schema_version, source_total_files and source_converted_files with defaults for what a document lacks."""
    return documents.select(
        F.coalesce("dataset_meta.schema_version", F.lit("unknown")).alias("schema_version"),
        F.coalesce("stats.total_files", F.lit(0)).alias("source_total_files"), F.coalesce("stats.converted_files", F.lit(0)).alias("source_converted_files"),
    )
