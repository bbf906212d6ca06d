"""WARC archives: writing records in segments, and segment reassembly when reading.

Method: payloads are written as HTTP responses in chunked transfer framing. A record block above SEGMENT bytes is
cut: the first part is segment 1, the rest are continuation records that name their origin, the last
with the total length. Reading groups the segments by origin identifier, orders them by number,
verifies that none is missing and that the length is right, and decodes the chunks. Unsegmented records
need no grouping and are decoded where they are read.

Archives are written and read with Spark's own writers and readers, so they can lie in any store that Spark
reaches, and a lost task is written again. Records and segments are written in rows of about ROW_BYTES, and a file takes ROWS_PER_FILE of them, so a file
has a bounded size however long the payloads are. The length and digest that a revisit names are checked against the response it refers to.

Defined results: a null payload counts as empty. Of equal payloads, the row of least page_id is the response and the
others are revisits of it (rows that repeat that page_id too are responses). A null page_id is
a response only if no other has its payload. Payloads of any length that a Spark value can hold (2 GB) are whole records again after reading. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramatis.llm.common import BATCH_BYTES, Scratch, table

SEGMENT, CHUNK, DATE = 32_768, 8192, "2024-01-01T00:00:00Z"
#: Bytes of records that are written as one row (the last record may pass them), and such rows of a file: about 32 MB before compression.
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 32
#: Payloads below this size are never revisits.
REVISIT_LEAST = 0
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
VERSION = b"WARC/1.1\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", len(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def records(record_id: str, url: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of a page, or its segments."""
    shown = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record("revisit", record_id, [*shown, profile, ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], HEAD)
        return
    block = HEAD + chunked(payload)
    shown.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        yield record("response", record_id, shown, block)
        return
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    yield record("response", record_id, [*shown, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield record("continuation", f"{record_id}:{k}", [("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k), *total], part)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(archive):
        if archive[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, archive[end + 4 : end + 4 + size]
        at = end + 8 + size


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE, revisit_least: int = REVISIT_LEAST) -> None:
    """Write gzip-compressed archives of ``pages`` to the folder ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    scratch = Scratch(pages.sparkSession, "warc-keys")
    keys = scratch.keep(rows.select("page_id", "same", F.length("payload").alias("size")), "keys")
    least = scratch.keep(keys.where(F.col("size") >= revisit_least).groupBy("same").agg(F.min("page_id").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    revisits = scratch.keep(keys.join(least, "same").where("NOT page_id <=> origin").select(F.col("page_id").alias("revisit_id"), F.col("same").alias("revisit_same"), "origin").distinct(), "revisits")
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("same") == F.col("revisit_same")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The writer ends each row with a line feed, which is the last byte of a record.
        row = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(made)[:-1]], pa.binary())], ["record"])
        task, n, made, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                page_id, url, data, origin = (v.as_py() for v in values)
                n += 1
                name = "null" if page_id is None else str(page_id)
                clean = (url or "").replace("\r", " ").replace("\n", " ")
                for part in records(f"urn:page:{name}:{task}-{n}", clean, data, None if origin is None else f"urn:page:{origin}", segment):
                    made.append(part)
                    held += len(part)
                    if held >= row_bytes:
                        yield row()
                        made, held = [], 0
        if made:
            yield row()

    written = marked.select("page_id", "url", "payload", "origin").mapInArrow(run, "record binary")
    written.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """From archives in the folder ``path``: record_id, record_type, refers_to (record), payload (null for a revisit), and what the headers say of it."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["record_id", "record_type", "refers_to", "number", "total", "said_digest", "said_bytes", "block"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: tuple[list, ...] = tuple([] for _ in range(8))
                held = 0
                for headers, block in parsed(zlib.decompress(content.as_buffer(), 31)):
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = tuple([] for _ in range(8)), 0
                    held += len(block)
                    number = headers.get("warc-segment-number")
                    values = (
                        headers.get("warc-segment-origin-id", headers["warc-record-id"]).strip("<>"),
                        headers["warc-type"],
                        headers.get("warc-refers-to", "").strip("<>") or None,
                        int(number) if number else None,
                        int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
                        headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        int(headers["x-payload-length"]) if "x-payload-length" in headers else None,
                        block,
                    )
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                yield batch_of(rows)

    parts = files.mapInArrow(run, "record_id string, record_type string, refers_to string, number int, total long, said_digest string, said_bytes long, block binary")
    single = parts.where("number is null").drop("number", "total")
    # A record is one page, so the segments of an origin fit a task.
    joined = parts.where("number is not null").groupBy("record_id").agg(
        F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"), F.max("said_digest").alias("said_digest"), F.max("said_bytes").alias("said_bytes"),
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"),
    )
    numbers = F.transform("segments", lambda s: s.number)
    block = F.aggregate("segments", F.lit(b""), lambda a, s: F.concat(a, s.block))
    whole = joined.withColumn("block", block).withColumn("ok", (numbers == F.sequence(F.lit(1), F.size("segments"))) & (F.length("block") == F.col("total")))
    whole = whole.withColumn("block", F.when(F.col("ok"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), F.col("record_id"), F.lit(" are missing or of wrong length"))).cast("binary")))
    return single.unionByName(whole.select(*single.columns))


def payloads(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from records read back; digests are recomputed from decoded payloads and verified."""

    def page(name: str | None) -> int | None:
        text = (name or "").split(":")[2:3]
        return int(text[0]) if text and text[0] != "null" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = tuple([] for _ in range(5))
            for name, kind, refers, said, size, block in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    data = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if said != digest(data) or size != len(data):
                        raise ValueError(f"payload of {name} is not what its record says")
                for column, value in zip(rows, (page(name), size, said, kind, page(refers)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read.select("record_id", "record_type", "refers_to", "said_digest", "said_bytes", "block").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def verified(pages: DataFrame) -> DataFrame:
    """``pages`` as ``payloads`` gives them; a revisit that names another length or digest than its response, or none that there is, is an error."""
    told = F.struct("payload_bytes", "payload_digest")
    revisits = pages.where("record_type = 'revisit'")
    known = pages.where("record_type = 'response'").select(F.col("page_id").alias("origin"), told.alias("real")).distinct()
    held = revisits.withColumn("said", told).join(known, (F.col("refers_to") == F.col("origin")) & (F.col("said") == F.col("real")), "left")
    wrong = F.raise_error(F.concat(F.lit("revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" has no such response"))).cast("long")
    checked = held.withColumn("refers_to", F.when(F.col("origin").isNotNull(), F.col("refers_to")).otherwise(wrong))
    return pages.where("record_type = 'response'").unionByName(checked.select(*pages.columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"))
    return verified(scratch.keep(payloads(read_archives(spark, scratch.path("archives"))), "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS origin, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5*j+1] AS INT) + 8 * CAST(bits[5*j+2] AS INT) + 4 * CAST(bits[5*j+3] AS INT) + 2 * CAST(bits[5*j+4] AS INT) + CAST(bits[5*j+5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM b
"""
