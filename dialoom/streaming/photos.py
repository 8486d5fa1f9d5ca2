"""Photos as they arrive, with a ledger of attempts: what was tried, what came of it, and when the next try is due.

The ledger is a table that each round appends to. A photo's last row tells where it stands: success, failed for good,
or retry. A round takes what has arrived and what is due, and writes what came of it under its own name; a round whose
rows stand is never run again, so that a photo with a page isn't sent once more after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ocr
from ..sources import files, trees
from .ingest import FILE

LEDGER = "path string, stem string, round string, attempts int, status_code int, status string, text string, next_try timestamp"
SUCCESS, FAILED, RETRY = "success", "failed", "retry"


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """All attempts so far; none before the first round."""
    return spark.read.schema(LEDGER).parquet(out) if files.existing(spark, [out]) else spark.createDataFrame([], LEDGER)


def standing(attempts: DataFrame) -> DataFrame:
    """Each photo's last attempt."""
    columns = [c for c in attempts.columns if c != "stem"]
    last = attempts.groupBy("stem").agg(F.max_by(F.struct(*columns), "attempts").alias("last"))  # a row for each photo
    return last.select("stem", "last.*")


def attempt(photos: DataFrame, client: ocr.Client, name: str, most: int = 3, wait: float = 60.0, now: Column | None = None, **kind) -> DataFrame:
    """Ledger rows of one attempt at each of photos (path, stem, content, attempts so far): one call each.

    A status of 500 and a client's exception are tried again after wait seconds, twice as many each time, until there
    were most attempts; any other failure is final, and so is an answer without text.
    """
    now = F.current_timestamp() if now is None else now
    sent = photos.select("path", "stem", "content", (F.col("attempts") + 1).alias("attempts"))
    called = ocr.call(sent.select("stem", "content"), client, attempts=1, **kind)
    came = called.withColumn("text", F.when(F.col("status_code") == 200, ocr.page_text(F.col("body")))).select("stem", "status_code", "text")
    again = (F.col("status_code").isNull() | (F.col("status_code") == 500)) & (F.col("attempts") < most)
    status = F.when(F.length("text") > 0, SUCCESS).when(again, RETRY).otherwise(FAILED)
    due = F.when(F.col("status") == RETRY, now + F.make_dt_interval(secs=F.lit(wait) * F.pow(F.lit(2.0), F.col("attempts") - 1)))
    rows = sent.drop("content").join(came, "stem").withColumn("status", status).withColumn("next_try", due.cast("timestamp"))
    return rows.select("path", "stem", F.lit(name).alias("round"), F.col("attempts").cast("int").alias("attempts"), "status_code", "status", F.when(F.col("status") == SUCCESS, F.col("text")).alias("text"), "next_try")


def with_content(due: DataFrame) -> DataFrame:
    """Adds content, what the file at a path holds now; a file that is gone has no row."""

    def of(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths:
            system, at = trees.located(p.as_py())
            try:
                with system.open_input_stream(at) as stream:
                    out.append(stream.read())
            except FileNotFoundError:
                out.append(None)
        return pa.array(out, pa.binary())

    return due.withColumn("content", F.arrow_udf(of, "binary")(F.col("path"))).where("content IS NOT NULL")


def take(spark: SparkSession, arrivals: DataFrame | None, out: str, client: ocr.Client, name: str, now: Column | None = None, content: Callable[[DataFrame], DataFrame] = with_content, **kind) -> None:
    """One round, called name: photos that arrived (path, stem, content), but for those the ledger has, and those due for another try. Does nothing if that round has been written."""
    if files.existing(spark, [f"{out}/round={name}/_SUCCESS"]):
        return
    known = standing(ledger(spark, out))
    due = known.where((F.col("status") == RETRY) & (F.col("next_try") <= (F.current_timestamp() if now is None else now)))
    todo = content(due.select("path", "stem", "attempts")).select("path", "stem", "content", "attempts")
    if arrivals is not None:
        fresh = arrivals.dropDuplicates(["stem"]).join(known.select("stem"), "stem", "left_anti")
        todo = todo.unionByName(fresh.select("path", "stem", "content", F.lit(0).alias("attempts")))
    attempt(todo, client, name, now=now, **kind).write.mode("overwrite").parquet(f"{out}/round={name}")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, client: ocr.Client, per_batch: int = 1000, **kind) -> StreamingQuery:
    """Takes all photos of a folder that there are now and weren't before, batch by batch; a later call goes on from there. Retries that are due go along; take without arrivals gives them a round of their own."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    photos = stream.where(F.lower(base).rlike(r"\.(jpg|jpeg|png|bmp)$")).select("path", F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), "content")
    write = lambda batch, number: take(spark, batch, out, client, f"batch-{number}", **kind)
    return photos.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(attempts: DataFrame) -> DataFrame:
    """One row: photos with a page, failed for good and to be tried again, and all attempts."""
    now = standing(attempts)
    return now.agg(
        F.count_if(F.col("status") == SUCCESS).alias("success"), F.count_if(F.col("status") == FAILED).alias("failed"),
        F.count_if(F.col("status") == RETRY).alias("retry"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
    )
