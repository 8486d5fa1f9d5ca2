"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def public_vocabulary(name: str) -> str:
    """Where a public vocabulary file lies: in TOKENIZERS_DIR, else where public_tokenizers has it, else in /opt/tokenizers."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return str(public_tokenizers.path(name))


#: The separators of the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at the same six.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: Rows in a batch that goes to a Python worker.
BATCH = 1000
_BATCH_KEY, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bound_batches(spark: SparkSession) -> None:
    """Sends fewer rows to a Python worker at once than Spark does unasked, as texts can be long. A session's own value stays."""
    if spark.conf.get(_BATCH_KEY) == _SPARKS_OWN:
        spark.conf.set(_BATCH_KEY, BATCH)


class Recent:
    """What a worker remembers of keys it has seen, within a number of bytes, in two generations: what is full becomes the older one.

    Plain dicts of plain values, which the garbage collector needn't walk. known.get serves the common case; what it
    lacks may still be among the older ones. A key that takes more than a sixteenth of the room isn't kept.
    """

    #: What an entry takes beside its key and value.
    ENTRY = 150

    def __init__(self, limit: int) -> None:
        self.known: dict = {}
        self.older: dict = {}
        self.limit = self.room = limit

    def find(self, key):  # noqa: ANN001, ANN201
        """The value of a key, or None; one of the older generation is taken into the newer."""
        value = self.known.get(key)
        if value is None and (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:  # noqa: ANN001
        size = len(key) + (len(value) if isinstance(value, bytes) else 16) + self.ENTRY
        if 16 * size < self.limit:
            if self.room < size:
                self.older, self.known, self.room = self.known, {}, self.limit
            self.room -= size
            self.known[key] = value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, to be read by the operators in bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: on a cluster it names the folder that all machines share")
    return found.rstrip("/") if found else f"file://{tempfile.gettempdir()}/dialoom-shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def each(column: pa.Array) -> Iterator:
    """The values of a column one at a time, so that a batch of texts isn't held a second time as strings."""
    return (x.as_py() for x in column)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32(id as text) mod modulus; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: Column, bound: int, slack: float = 0.9) -> DataFrame:
    """About slack * bound rows (all, if fewer), chosen by a hash of key, so that it's the same in each run.

    Only for fitting; df must be cheap to count.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * slack * bound / n))
