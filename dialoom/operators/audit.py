"""Audit of the ids that file names begin with: coverage, duplicates, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import prefix_ids


def named_ids(files: DataFrame) -> DataFrame:
    """folder, name, ids of files with folder, name and stem."""
    return files.select("folder", "name", prefix_ids(F.col("stem")).alias("ids"))


def occurrences(named: DataFrame) -> DataFrame:
    """folder, id, name: a row each time that a name has an id."""
    return named.select("folder", "name", F.explode("ids").alias("id"))


def folder_counts(named: DataFrame) -> DataFrame:
    """Per folder: files, those with ids, ids in all and distinct ids."""
    files = named.groupBy("folder").agg(F.count("*").alias("file_count"), F.count_if(F.size("ids") > 0).alias("parsed_file_count"))
    ids = occurrences(named).groupBy("folder").agg(F.count("*").alias("total_prefix_count"), F.count_distinct("id").alias("unique_prefix_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(ids, "folder", "left").select("folder", "file_count", "parsed_file_count", zero("total_prefix_count"), zero("unique_prefix_count"))


def without_ids(named: DataFrame) -> DataFrame:
    return named.where(F.size("ids") == 0).select("folder", "name")


def duplicates(named: DataFrame) -> DataFrame:
    """folder, id, n of the ids that occur more than once in a folder."""
    return occurrences(named).groupBy("folder", "id").agg(F.count("*").alias("n")).where("n > 1")


def index(named: DataFrame) -> DataFrame:
    """folder, id, names: the sorted names of files with an id, one for each occurrence."""
    return occurrences(named).groupBy("folder", "id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def all_ids(named: DataFrame) -> DataFrame:
    """id: the distinct ids of all folders."""
    return occurrences(named).select("id").distinct()


def difference(ids: DataFrame, others: DataFrame) -> DataFrame:
    """id: the distinct ids that others lacks."""
    return ids.select("id").distinct().join(others.select("id"), "id", "left_anti")


def missing_ranges(ids: DataFrame, first: int = 1, last: int = 133) -> DataFrame:
    """first and last of each run of numbers of a range that ids lacks, however far the ids are apart: work and memory go by rows.

    Ids are dealt to partitions by ranges of their values, within which each meets the one before it. The two ends of
    each partition then meet those of its neighbours, which takes two rows a partition in one place. Ids that repeat,
    are null or lie outside the range do nothing.
    """
    known = ids.select(F.col("id").cast("long").alias("id")).where(F.col("id").between(first, last)).distinct()
    bounds = ids.sparkSession.createDataFrame([(first - 1,), (last + 1,)], "id long")
    dealt = known.union(bounds).repartitionByRange("id").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("id")
    edge = F.lag("id").over(within).isNull() | F.lead("id").over(within).isNull()
    met = dealt.select("id", "part", F.lag("id").over(within).alias("before"), edge.alias("edge"))
    # edges have a partition of their own, in which the end of one range comes before the begin of the next
    among_edges = Window.partitionBy(F.when(F.col("edge"), -1).otherwise(F.col("part"))).orderBy("id")
    before = F.coalesce("before", F.when(F.col("edge"), F.lag("id").over(among_edges)))
    return met.select("id", before.alias("before")).where(F.col("id") - F.col("before") > 1).select((F.col("before") + 1).alias("first"), (F.col("id") - 1).alias("last"))


def missing_ids(ids: DataFrame, first: int = 1, last: int = 133) -> DataFrame:
    """id: the numbers of a range that ids lacks, from the runs of missing_ranges."""
    return missing_ranges(ids, first, last).select(F.explode(F.sequence("first", "last")).alias("id"))
