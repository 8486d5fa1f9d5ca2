"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows of an input of fewer partitions than there are cores, as a small table in one file has, dealt to all cores by their keys; a larger input as it is, without a shuffle.

    For work that is heavy for each row and takes rows one by one.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, F.xxhash64(*key)) if rows.rdd.getNumPartitions() < cores else rows
