"""Photos to text through a client that is given; none is built in, and neither is an address or a token."""

from __future__ import annotations

import base64
import io
import time
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A client takes a request and gives (HTTP status, response body). It's pickled to the tasks.
Client = Callable[[dict], tuple[int, str]]
RESPONSE = "struct<result:struct<layoutParsingResults:array<struct<markdown:struct<text:string>>>>>"
LONGEST_SIDE, JPEG_QUALITY = 2000, 85


def request(content: bytes, prepare: Callable[[bytes], bytes] | None = None) -> dict:
    """The request for one image."""
    return {"file": base64.b64encode((prepare or shrink)(content)).decode(), "fileType": 1, "useDocOrientationClassify": True, "useDocUnwarping": False, "useChartRecognition": False}


def shrink(content: bytes) -> bytes:
    """The image as JPEG with its longest side bounded; as it is, with a warning, where Pillow isn't installed."""
    try:
        from PIL import Image
    except ImportError:
        warnings.warn("Pillow isn't installed: photos are sent at full size", stacklevel=2)
        return content
    image = Image.open(io.BytesIO(content)).convert("RGB")
    image.thumbnail((LONGEST_SIDE, LONGEST_SIDE), Image.Resampling.LANCZOS)
    out = io.BytesIO()
    image.save(out, "JPEG", quality=JPEG_QUALITY)
    return out.getvalue()


def pending(images: DataFrame, done: DataFrame) -> DataFrame:
    """The images whose stem has no result yet."""
    return images.join(done.select("stem").distinct(), "stem", "left_anti")


def call(images: DataFrame, client: Client, attempts: int = 3, pause: float = 2.0, pacing: float = 0.5, timeout: float = 120.0, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """stem, status_code, body, tries of each image: what the client gave. A null body after exceptions alone.

    Status 500 and exceptions are tried again; any other status is final. Tasks go image by image. timeout: seconds
    that the client is to wait, beside the request's fields. prepare: what is done to an image first, by default shrink.
    """

    def one(content: bytes) -> tuple[int | None, str | None, int]:
        status = body = None
        for n in range(1, attempts + 1):
            try:
                status, body = client(request(content, prepare) | {"timeout": timeout})
            except Exception:  # noqa: BLE001  a client's faults are data here
                status = body = None
            if status not in (None, 500):
                return status, body, n
            if n < attempts:
                time.sleep(pause)
        return status, body, attempts

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, content in zip(batch.column("stem").to_pylist(), batch.column("content").to_pylist()):
                status, body, tries = one(content)
                time.sleep(pacing)
                yield pa.RecordBatch.from_arrays([pa.array([stem], pa.string()), pa.array([status], pa.int32()), pa.array([body], pa.string()), pa.array([tries], pa.int32())], ["stem", "status_code", "body", "tries"])

    return images.select("stem", "content").mapInArrow(of, "stem string, status_code int, body string, tries int")


def page_text(body: Column) -> Column:
    """The pages' markdown of a response, joined by line ends; null for what isn't such a response."""
    pages = F.from_json(body, RESPONSE)["result"]["layoutParsingResults"]
    return F.array_join(F.transform(pages, lambda p: p["markdown"]["text"]), "\n")


def results(called: DataFrame) -> DataFrame:
    """stem, text, status: success where the response is good and has text, else failed."""
    df = called.withColumn("text", F.when(F.col("status_code") == 200, page_text(F.col("body"))))
    return df.select("stem", "text", F.when(F.length("text") > 0, "success").otherwise("failed").alias("status"))


def counts(images: DataFrame, done: DataFrame, called: DataFrame) -> DataFrame:
    """One row: success, skipped and failed images."""
    skipped = images.join(done.select("stem").distinct(), "stem", "left_semi").agg(F.count("*").alias("skipped"))
    return results(called).agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed")).crossJoin(skipped)
