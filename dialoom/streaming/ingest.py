"""Dialogues as they arrive: the build's parse on a file stream, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..plans.build import build

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """file_id, path, stem, text, error of each new *.txt of a folder."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", per_batch).load(folder)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return stream.select(F.xxhash64("path").alias("file_id"), "path", stem.alias("stem"), F.when(good, text).alias("text"), F.when(~good, "bad_utf8").alias("error"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, sheet: DataFrame | None = None, tallies: str | None = None) -> StreamingQuery:
    """Builds the patients of all files there are now and appends them to out; a later call goes on from there.

    tallies: where to append what each batch adds to the summary, which summary_so_far reads without the patients.

    A batch that is run again after a failure writes to the folder of its number, so that no patient comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        place = f"{out}/batch={number}"
        build(batch, sheet).write.mode("overwrite").parquet(place)
        if tallies:
            stats.tallied(spark.read.parquet(place)).write.mode("overwrite").parquet(f"{tallies}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_so_far(spark: SparkSession, tallies: str) -> DataFrame:
    """The summary of all batches."""
    return stats.figures(spark.read.parquet(tallies).drop("batch"))
