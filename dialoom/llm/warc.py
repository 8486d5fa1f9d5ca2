"""WARC archives as a chunked record table.

Writing: each record's payload is cut into chunks, rows of (record, chunk number), and each chunk becomes a WARC
record; those after the first are continuation records. Spark's text writer puts them down, with the blank lines
that end a record as its line separator, so that archives can be in any store. Reading: archives are inflated bit
by bit into chunk rows again, and digests are carried from chunk to chunk; no task holds a whole long payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

CHUNK = 1 << 16
#: Payloads shorter than this are never replaced by a revisit.
LEAST = 100
#: Records in an archive file at most, which bounds its size.
RECORDS = 2000
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEW_LINE = "\r\n"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Adds payload, bytes, digest and first to page_id and url: first is the smallest page_id with that payload.

    Payloads are matched by digest and size; short ones stand alone. Copies are counted by key before they meet
    the pages, and Spark splits the join where one payload has very many copies.
    """
    df = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).select("page_id", "url", "payload")
    df = df.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    df = df.withColumn("key", F.when(F.col("bytes") >= LEAST, F.concat_ws(":", "digest", "bytes")).otherwise(alone))
    slim = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    slim = slim.where(F.octet_length("payload") >= LEAST).select("page_id", F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")).alias("key"))
    copies = slim.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")  # min leaves out nulls
    return df.join(copies, "key", "left").drop("key")


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null field is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_NEW_LINE)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{_NEW_LINE}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(_NEW_LINE))


def response(page_id: Column, digest: Column) -> Column:
    """The record id of a page's response, which revisits name. Rows that are repeated whole share it."""
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit("#"), digest, F.lit(">"))


def chunk_rows(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row, record, page_id, url, bytes, digest, refers_to, chunk number (from 1), chunks and data of each chunk.

    A revisit has one chunk without data. page_id may repeat or be null: row tells rows apart.
    """
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    df = marked.select(
        F.monotonically_increasing_id().cast("string").alias("row"), page.alias("page"),
        "page_id", "url", "bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    own = F.concat(F.lit("<urn:page:"), F.col("page"), F.lit("#"), F.col("row"), F.lit(">"))
    named = F.col("refers_to").isNull() & F.col("page_id").isNotNull()
    df = df.withColumn("record", F.when(named, response(F.col("page_id"), F.col("digest"))).otherwise(own)).drop("page")
    chunks = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / chunk)).cast("int")
    df = df.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    data = F.substring(F.col("payload"), (F.col("chunk") - 1) * chunk + 1, F.lit(chunk))
    return df.withColumn("data", F.coalesce(data, F.lit(b""))).drop("payload")


def write(rows: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """Writes chunk rows as gzipped WARC 1.1 files. A URL's line ends are escaped; a null URL has no field."""
    first, many = F.col("chunk") == 1, F.col("chunks") > 1
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_NEW_LINE}Content-Type: text/html; charset=utf-8{_NEW_LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(_NEW_LINE * 2))
    block = F.concat(F.when(first, http).otherwise(F.lit("")).cast("binary"), F.col("data"))
    number = lambda c: F.concat(F.substring_index("record", ">", 1), F.lit("."), c.cast("string"), F.lit(">"))
    header = _header(
        ("WARC-Type", F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))),
        ("WARC-Record-ID", F.when(first, F.col("record")).otherwise(number(F.col("chunk")))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.translate(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", " ")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("digest")))),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), response(F.col("refers_to"), F.col("digest")))),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("record"))),
        ("WARC-Segment-Number", F.when(many, F.col("chunk"))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("chunk") == F.col("chunks")), F.col("bytes"))),
        ("X-Row", F.col("row")),
        ("X-Payload-Length", F.when(first, F.col("bytes"))),
        ("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        ("Content-Length", F.octet_length(block)),
    )
    line = F.concat(header.cast("binary"), block).cast("string")  # the writer takes the bytes as they are
    out = rows.select(line.alias("value")).write.option("lineSep", _NEW_LINE * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).text(path)


def parse(content: bytes, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a gzipped archive, which is inflated a piece at a time.

    A truncated archive's last block is short; nothing is read after a fault of the compression or a header without a length.
    """
    inflate, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal inflate, at
        while True:
            if inflate.eof:  # of a member, which other writers begin anew for each record
                at -= len(inflate.unused_data)
                inflate = zlib.decompressobj(31)
            if at >= len(content) and not inflate.unconsumed_tail:
                return False
            data = inflate.unconsumed_tail or content[at : at + piece]
            at += 0 if inflate.unconsumed_tail else len(data)
            try:
                got = inflate.decompress(data, piece)
            except zlib.error:  # what follows can't be read
                at, inflate = len(content), zlib.decompressobj(31)
                return False
            held.extend(got)
            if got:
                return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = held[:end].decode("utf-8", "replace").split(_NEW_LINE)
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not header.get("content-length", "").isdigit():
            return
        stop = end + 4 + int(header["content-length"])
        while len(held) < stop + 4 and more():
            pass
        yield header, bytes(held[end + 4 : stop])
        del held[: stop + 4]


_PAGE, _NUMBER, _DIGEST = re.compile(r"<urn:page:(-?[0-9]{1,19})[#>]"), re.compile("-?[0-9]{1,19}"), re.compile("sha256:([0-9a-f]{64})")
CHUNK_DDL = "record string, page_id long, url string, type string, refers_to long, chunk int, segmented boolean, bytes long, digest string, data binary"


def read(spark: SparkSession, path: str, batch_bytes: int = 1 << 24) -> DataFrame:
    """The chunk rows of the archives in a folder. bytes and digest are what the header says, null in continuations.

    Archives of other writers are read as well: of records that aren't responses, revisits or continuations nothing is
    kept; a record id or a reference that names no page gives a null page_id or refers_to, and a number or a digest
    that is none of ours counts as not told.
    """
    names = [x.split()[0] for x in CHUNK_DDL.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def number(text: str | None, most: int, default: int | None = None) -> int | None:
        return int(text) if text and _NUMBER.fullmatch(text) and abs(int(text)) <= most else default

    def page(urn: str | None) -> int | None:
        found = _PAGE.match(urn or "")
        return number(found[1], (1 << 63) - 1) if found else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for contents in batches:
            for content in contents.column("content"):
                for h, block in parse(content.as_py()):
                    record = h.get("warc-segment-origin-id") or h.get("warc-record-id")
                    if not record or h.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    body = block.find(b"\r\n\r\n")
                    data = block if h["warc-type"] == "continuation" else block[body + 4 :] if body >= 0 else b""
                    length, digest = number(h.get("x-payload-length"), 1 << 62), _DIGEST.fullmatch(h.get("warc-payload-digest", ""))
                    segment = number(h.get("warc-segment-number"), 1 << 30)
                    out.append((f"{record} {h.get('x-row', '')}", page(record), h.get("warc-target-uri"), h["warc-type"], page(h.get("warc-refers-to")), segment or 1, segment is not None, length, digest and digest[1], data))
                    size += len(data) + 500
                    if size >= batch_bytes:
                        yield batch()
                        out.clear()
                        size = 0
        if out:
            yield batch()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, CHUNK_DDL)


def records(chunks: DataFrame) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_to, chunks, intact of each record of chunk rows.

    A record in one chunk is digested where it is; the chunks of longer ones meet, sorted, in one task, which
    carries the digest from chunk to chunk. intact: what was read has the size and digest that its header says; of a
    revisit, whose payload is elsewhere, that its header says them. It is null where the header says neither, as other
    writers' do.
    """
    whole = ~F.col("segmented")
    slim = chunks.select(
        "record", "page_id", "type", "refers_to", "chunk", "bytes", "digest", F.octet_length("data").cast("long").alias("size"),
        F.when(whole, F.sha2("data", 256)).alias("sha"), F.when(~whole, F.col("data")).alias("data"),
    )
    names = ("record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks", "intact")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, size, n = None, None, 0, 0
        out: list[tuple] = []

        def done() -> None:
            sha = state.hexdigest() if state else head["sha"]
            told = (head["bytes"], head["digest"])
            got = told if head["type"] == "revisit" else (size, sha)
            kind = "revisit" if head["type"] == "revisit" else "response"
            intact = None if told == (None, None) else got == told and None not in told
            out.append((head["record"].rpartition(" ")[0], head["page_id"], *got, kind, head["refers_to"], n, intact))

        for batch in batches:
            for row in batch.to_pylist():
                if head is None or row["record"] != head["record"]:
                    if head:
                        done()
                    head, size, n = row, 0, 0
                    state = None if row["sha"] else hashlib.sha256()
                if state:
                    state.update(row["data"])
                    row["data"] = None
                size, n = size + row["size"], n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names))
                out.clear()
        if head:
            done()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names))

    together = slim.repartition("record").sortWithinPartitions("record", "chunk")
    return together.mapInArrow(carry, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks int, intact boolean")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from archives of all pages, which stay in the shared folder.

    A null html is an empty payload; pages that share the smallest page_id of a payload are all responses.
    """
    path = new_path(spark, "warc")
    write(chunk_rows(mark_revisits(table(spark, sf_dir, "pages"))), path)
    return records(read(spark, path)).drop("record_id")
