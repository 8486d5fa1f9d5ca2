"""The audit of ids as files arrive: what each file adds to what all before it had.

State goes by folder and id: how often the id has come. Each sighting is written once with its number, so that first
sightings and repetitions are known across batches, and the whole audit is a sum over the sightings there are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.clinical import prefix_ids
from ..operators import audit
from .ingest import FILE

SIGHTING = "folder string, id int, name string, head boolean, nth long"
#: What transformWithState keeps its state in.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sightings(StatefulProcessor):
    """Numbers the sightings of an id in a folder. The state is one number, however many there have been."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        for row in rows:
            n += 1
            yield Row(folder=row.folder, id=row.id, name=row.name, head=row.head, nth=n)
        self.seen.update((n,))

    def close(self) -> None:
        pass


def occurrences(files: DataFrame) -> DataFrame:
    """folder, name, id and head of each id that each file's stem begins with; a file without one has a row with a null id. head marks one row of each file."""
    rows = files.select("folder", "name", F.posexplode_outer(prefix_ids(F.col("stem"))).alias("at", "id"))
    return rows.select("folder", "name", "id", F.coalesce(F.col("at") == 0, F.lit(True)).alias("head"))


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 10_000) -> StreamingQuery:
    """Appends the sightings of all files that there are now and weren't before to out; a later call goes on from there.

    A batch that is run again writes to the folder of its number: no sighting comes twice.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    named = stream.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.txt$", "").alias("stem"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        numbered = occurrences(named).groupBy("folder", "id").transformWithState(Sightings(), SIGHTING, "append", "None")
        return numbered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # the query has its own copy of the settings
        spark.conf.set(_STORE[0], before)


def sightings(spark: SparkSession, out: str) -> DataFrame:
    """All sightings so far."""
    return spark.read.schema(SIGHTING).parquet(out)


def folder_counts(seen: DataFrame) -> DataFrame:
    """audit.folder_counts of sightings: nothing but sums, as first sightings are known."""
    known = F.col("id").isNotNull()
    return seen.groupBy("folder").agg(
        F.count_if("head").alias("file_count"), F.count_if(F.col("head") & known).alias("parsed_file_count"),
        F.count("id").alias("total_prefix_count"), F.count_if(known & (F.col("nth") == 1)).alias("unique_prefix_count"),
    )


def duplicates(seen: DataFrame) -> DataFrame:
    """audit.duplicates of sightings."""
    return seen.where("id IS NOT NULL").groupBy("folder", "id").agg(F.max("nth").alias("n")).where("n > 1")


def index(seen: DataFrame) -> DataFrame:
    """audit.index of sightings."""
    return seen.where("id IS NOT NULL").groupBy("folder", "id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def without_ids(seen: DataFrame) -> DataFrame:
    return seen.where("id IS NULL").select("folder", "name")


def first_sightings(seen: DataFrame) -> DataFrame:
    """id of the first sightings in each folder."""
    return seen.where("nth = 1 AND id IS NOT NULL").select("id")


def missing_ranges(seen: DataFrame, first: int = 1, last: int = 133) -> DataFrame:
    return audit.missing_ranges(first_sightings(seen), first, last)
