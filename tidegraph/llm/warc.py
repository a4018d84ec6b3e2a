"""WARC archives: write captures, read records back, assemble captures again.

A capture is three records written one after another: request, response (or revisit, when an
earlier page has the same payload) and metadata. Response and metadata name the request as
WARC-Concurrent-To. Reading back gives one row per record; captures are assembled by joining the
records on the request's id, whatever file or order they came in.

Scale: equal payloads are found with a grouped minimum over their digests (combined before the
shuffle). Up to MOST_REPEATED repeated digests (counted first) are broadcast, so that pages aren't
shuffled to be written; with more it is an equi join whose skew AQE splits. Files hold
at most `captures_per_file` captures and are written by Spark's own writer, so a lost task leaves no
partial file. Reading unpacks a file as a stream, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

VERSION = "WARC/1.1"
CRLF = "\r\n"
MOST_REPEATED = 200_000  # digests that occur more than once, with an id each: some 20 MB
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest) -> F.Column:
    """Bare upper-case base32 of a SHA-1 in hex, 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, i + 1, 10), 16, 32), 8, "0") for i in range(0, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, F.Column | str]], block) -> F.Column:
    """A record without the two line ends that close it. Header values lose line breaks."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        value = value if isinstance(value, F.Column) else F.lit(value)
        lines.append(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, captures_per_file: int = 5_000) -> None:
    """One capture per row, in gzipped WARC files under `path`.

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the smallest id is
    written as response and the others as revisits of it; rows that repeat that id are responses
    too, and rows without an id always are. Null payloads and urls count as empty. Other columns
    aren't read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    first = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    target = F.when(F.col("first") < F.col("id"), F.col("first"))
    # usually few payloads repeat: with their number known, the payloads needn't be shuffled
    few = first.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED
    captures = (rows.join(F.broadcast(first) if few else first, "digest", "left").withColumn("target", target)
                .withColumn("request", F.expr("uuid()"))
                .withColumn("sha1", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))))
    urn = lambda part: F.concat(F.lit(f"<urn:capture:{part}:"), F.col("request"), F.lit(">"))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    page = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("target").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}"), F.col("payload"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", urn("request")), *common,
                       ("Content-Type", "application/http; msgtype=request")], F.lit(f"GET / HTTP/1.1{CRLF * 2}"))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", urn("response")), ("WARC-Concurrent-To", urn("request")), *common,
                        ("WARC-Payload-Digest", F.col("sha1")), ("Content-Type", "application/http; msgtype=response")], http)
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", urn("response")), ("WARC-Concurrent-To", urn("request")), *common,
                       ("WARC-Payload-Digest", F.col("sha1")), ("WARC-Refers-To", page), ("WARC-Profile", PROFILE),
                       ("Content-Type", "application/http; msgtype=response")], F.lit(f"HTTP/1.1 200 OK{CRLF * 2}"))
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{CRLF}payloadLength: "),
                      F.octet_length("payload").cast("string"), F.lit(CRLF))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", urn("metadata")), ("WARC-Concurrent-To", urn("request")), *common,
                        ("Content-Type", "application/warc-fields")], fields)
    # Spark's text writer closes every row, here a capture, with the separator
    capture = F.concat(request, F.lit(CRLF * 2), F.when(F.col("target").isNull(), response).otherwise(revisit), F.lit(CRLF * 2), metadata)
    (captures.select(capture.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", captures_per_file).text(path))


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a file in pieces; gzip, in one or many members, is unpacked."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    left = memoryview(data)
    while len(left):
        stream = zlib.decompressobj(31)
        for at in range(0, len(left), 1 << 20):
            yield stream.decompress(left[at:at + (1 << 20)])
            if stream.eof:
                left = left[at + (1 << 20) - len(stream.unused_data):] if len(left) > at + (1 << 20) else left[len(left) - len(stream.unused_data):]
                break
        else:
            yield stream.flush()
            return


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, by their lengths; header names in lower case."""
    buffer, pieces = bytearray(), _unpacked(data)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    at = 0
    while True:
        del buffer[:at]
        at = 0
        while fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("a record's headers are cut off")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split(CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length, start = int(headers["content-length"]), end + 4
        if not fill(start + length):
            raise ValueError("a record's block is cut off")
        yield headers, bytes(buffer[start:start + length])
        at = start + length


RECORDS = ("type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
           "payload_digest string, block binary")
HEADERS = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest"]


def read_records(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """One row per record of all WARC files under `path`, plain or gzipped; only `types`, if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n.split()[0], pa.binary() if n.endswith("binary") else pa.string()) for n in RECORDS.split(", ")])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in records(content.as_py()):
                    if types and headers.get("warc-type") not in types:
                        continue
                    rows.append((*(headers.get(h) for h in HEADERS), block))
                    size += len(block) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.transform(map_arrow, run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata), joined through the
    concurrent-to ids. `response` is a response or revisit record; parts that are missing are null.
    Records without a concurrent request are captures of their own, without one."""
    return _joined(*(found.filter(F.col("type").isin(*types)) for types in PARTS.values()))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """assemble(read_records(...)), with only the records of its kind on either side of the joins."""
    return _joined(*(read_records(spark, path, types) for types in PARTS.values()))


PARTS = {"response": ("response", "revisit"), "request": ("request",), "metadata": ("metadata",)}


def _joined(*parts: DataFrame) -> DataFrame:
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    row = F.struct(*(F.col(c.split()[0]) for c in RECORDS.split(", ")))
    responses, requests, metadata = (df.select(key, row.alias(name)) for name, df in zip(PARTS, parts))
    # payloads come last: a full join's key isn't that of either side, so its rows are shuffled again
    return (requests.join(metadata, "capture_id", "full").join(responses, "capture_id", "full")
            .select("capture_id", "request", "response", "metadata"))


def payload_of(block: F.Column) -> F.Column:
    """The body of an HTTP message (binary): what follows the first empty line."""
    at = F.locate(CRLF * 2, block.cast("string"))  # a head is ASCII: characters are bytes
    return F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block)


def field_of(metadata_block: F.Column, name: str) -> F.Column:
    """A field of an application/warc-fields block; null if it is missing or empty."""
    value = F.regexp_extract(F.decode(metadata_block, "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
