"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture becomes three records: a response (or a revisit, where another capture holds the same payload), and a
request and a metadata record that name it in WARC-Concurrent-To. Archives are gzipped text files of Spark's text
sink whose line separator is the two line ends that close a record; the sink compresses a file as one gzip member.
Reading streams the lines of an archive and goes by Content-Length, so payloads may hold anything and one record is in
memory at a time, however large the archive. Assembly brings the records of one transaction together by the
identifier they are concurrent to and emits a nested row per capture.

Which payloads recur is found from digests alone; bodies are dealt out by capture, or not at all where few payloads
recur, so equal payloads never meet in one task.

A null html is an empty payload, a null url an empty target. Rows equal in page_id, url and html are one capture.
Of equal payloads of at least min_payload bytes, the capture with the largest page_id is the response (all of them
if several rows have this page_id; null ids come last); smaller payloads are never revisits. A request or metadata
record without its response gives a row whose response is null. Very long payloads are written and read whole, empty
tables give no rows, columns besides page_id, url and html play no part.

What is no record is read as a row whose error says why: lines before the next line that begins a record, a record
without a valid Content-Length or cut off by the end of its archive (also of a truncated gzip file), a response without
the end of its HTTP headers, an archive of which nothing can be read (no gzip file, or none with a whole first block).
Reading goes on with the next record, or the next archive. assemble() leaves such rows out. What Spark's readers do not
tell: files of no bytes, which they leave out, and that an archive is damaged just between two records; those before the
damage are read, and no row says so.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import materialize, small_batches, spread_join, table, tidily

#: Records in an archive at most; the three of a capture may fall into two archives.
RECORDS_PER_ARCHIVE = 3_000
#: Recurring payloads up to which they are sent to every executor.
BROADCAST_ROWS = 200_000
#: Bytes of a gzip file that holds nothing, at most.
EMPTY_ARCHIVE_BYTES = 100
CRLF = "\r\n"
FETCHED = "2024-01-01T00:00:00Z"

#: Digits of base 32 as conv() writes them, and as RFC 4648 does.
DIGITS_CONV, DIGITS_RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column) -> Column:
    """RFC 4648 base 32 of 160 bits in hexadecimal: 5 hexadecimal digits are 4 of base 32."""
    groups = [F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS_CONV, DIGITS_RFC)


def urn(*parts: Column) -> Column:
    """A stable record identifier: md5 of the parts in the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(kind: Column, record_id: Column, url: Column, content_type: str, block: Column, *headers: Column) -> Column:
    """A record without the two line ends that close it; null headers are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), F.lit(f"WARC-Date: {FETCHED}"), line("WARC-Target-URI", url),
        *headers, F.lit(f"Content-Type: {content_type}"), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """pages: page_id, url, html."""
    pages = pages.select(
        "page_id",
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n_bytes": F.octet_length("html").cast("long")})
    pages = pages.withColumn("id", urn(F.col("page_id"), F.col("url"), F.col("digest")))
    # small rows, combined before the shuffle: only payloads that occur again
    payload = ["digest", "n_bytes"]
    found = pages.where(F.col("n_bytes") >= min_payload).groupBy(*payload).agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = materialize(found, "warc-payloads")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = pages.join(F.broadcast(again.drop("copies")), payload, "left")
    else:
        firsts = spread_join(pages.select("id", *payload), again, payload, pages.count(), "copies").select("id", "first").distinct()
        marked = pages.join(firsts, "id", "left")
    marked = marked.withColumns({"revisit": F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), "payload_digest": base32_of_hex(F.col("digest"))})
    c = F.col
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), c("n_bytes").cast("string"), F.lit(CRLF * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), c("payload_digest"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), c("id"))
    profile = F.when(c("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    path_of = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-zA-Z]+://[^/]*([^#]*)", 1), F.lit("")), F.lit("/"))
    ask = F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(CRLF * 2))
    facts = F.concat_ws(CRLF, F.concat(F.lit("pageId: "), c("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), c("n_bytes").cast("string")), F.when(c("revisit"), F.concat(F.lit("refersToPage: "), c("first").cast("string"))), F.lit(""))
    records = F.array(
        record(F.lit("request"), urn(F.lit("request"), c("id")), c("url"), "application/http; msgtype=request", ask, concurrent),
        record(F.when(c("revisit"), "revisit").otherwise("response"), c("id"), c("url"), "application/http; msgtype=response", F.when(c("revisit"), http).otherwise(F.concat(http, c("html"))), digest, profile),
        record(F.lit("metadata"), urn(F.lit("metadata"), c("id")), c("url"), "application/warc-fields", facts, concurrent),
    )
    marked.select(F.explode(records).alias("value")).write.options(lineSep=CRLF * 2, compression="gzip", maxRecordsPerFile=records_per_archive, **{"zlib.compress.level": "BEST_SPEED"}).text(path)


RECORD = "record_type string, record_id string, concurrent_to string, url string, date string, payload_digest string, payload_bytes long, page_id long, refers_to long, digest_ok boolean, archive string, error string"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]


class Reader:
    """Takes the lines of one archive and gives its records, each as (headers, block), or (None, what is wrong)."""

    def __init__(self):
        self.headers: dict[str, str] | None = None  # of the record that is being read, names in lower case
        self.block: list[bytes] | None = None  # its lines once the headers have ended
        self.left = 0  # bytes of the block to come
        self.stray = False

    def take(self, line: bytes) -> Iterator[tuple[dict[str, str] | None, bytes | str]]:
        if self.block is not None:
            self.block.append(line)
            self.left -= len(line) + 2  # what ends a line belongs to the block, but for the last line mostly
            if self.left <= 0:
                headers, block, over = self.headers, CRLF.encode().join([*self.block, b""]), self.left
                self.headers = self.block = None
                yield (None, "the block is longer than its Content-Length") if over < -2 else (headers, block[: int(headers["content-length"])])
        elif self.headers is not None:
            if line:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.headers[name.strip().lower()] = value.strip()
            elif (size := self.headers.get("content-length", "")).isascii() and size.isdigit():
                self.block, self.left = [], int(size)
                if not int(size):
                    headers, self.headers, self.block = self.headers, None, None
                    yield headers, b""
            else:
                self.headers = None
                yield None, "no valid Content-Length"
        elif line.startswith(b"WARC/"):
            self.headers, self.stray = {}, False
        elif line and not self.stray:
            self.stray = True
            yield None, "no record begins here"

    def end(self) -> Iterator[tuple[None, str]]:
        if self.headers is not None:
            yield None, "the archive ends within a record"


def row_of(headers: dict[str, str] | None, block: bytes | str) -> dict:
    """The fields of RECORD, but for the archive."""
    if headers is None:
        return {"error": block}
    kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = {"record_type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "payload_digest": stated}
    if kind == "response":
        head, end, body = block.partition(b"\r\n\r\n")
        if not end:
            return row | {"error": "no end of the HTTP headers"}
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        row |= {"payload_digest": digest, "payload_bytes": len(body), "digest_ok": digest == stated}
    elif kind == "metadata":
        facts = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
        whole = lambda x: int(x) if x is not None and x.removeprefix("-").isascii() and x.removeprefix("-").isdigit() else None
        row |= {"payload_bytes": whole(facts.get("payloadBytes")), "page_id": whole(facts.get("pageId")), "refers_to": whole(facts.get("refersToPage"))}
    return row


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the gzipped archives in path, and per place or archive that is none (with error). The rows, without
    the payloads, are written once, to be compared with the archives that there are. payload_digest is computed from the payload of a response, and digest_ok tells whether the record states the same; revisits give the
    digest that they state."""
    small_batches(spark)
    schema = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, archive = Reader(), None
        for batch in batches:
            rows = []
            for line, name in zip(batch.column("line").to_pylist(), batch.column("archive").to_pylist(), strict=True):
                if name != archive:
                    rows += [row_of(*x) | {"archive": archive} for x in reader.end()]
                    reader, archive = Reader(), name
                rows += [row_of(*x) | {"archive": name} for x in reader.take(line)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        yield pa.RecordBatch.from_pylist([row_of(*x) | {"archive": archive} for x in reader.end()], schema=schema)

    # a gzipped file is never split, and its lines come in order
    lines = spark.read.option("lineSep", CRLF).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.gz").text(path)
    found = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("archive")).mapInArrow(tidily(run), RECORD)
    found = materialize(found, "warc-records")
    unread = unread_archives(spark, path, found.select("archive").distinct())
    return found.unionByName(unread.select("archive", F.lit("nothing of the archive can be read").alias("error")), allowMissingColumns=True)


def unread_archives(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """archive: those in path that are not among read, but for gzip files that hold nothing. Of a large file no byte is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    name = F.col("_metadata.file_path").alias("archive")
    absent = files.select(name, "length").join(read, "archive", "left_anti")
    small = files.where(F.col("length") <= EMPTY_ARCHIVE_BYTES).select(name, "content")

    @F.pandas_udf("boolean")
    def empty(content):
        def holds_nothing(raw: bytes) -> bool:
            try:
                return bool(raw) and not gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                return False

        return content.map(holds_nothing)

    return absent.join(small.where(empty("content")), "archive", "left_anti").select("archive")


def assemble(records: DataFrame) -> DataFrame:
    """A row per transaction: transaction_id, and the structs request, response and metadata."""
    c = F.col
    of = lambda *kinds: c("record_type").isin(*kinds)
    return (
        records.where("error is null and record_id is not null").withColumn("transaction_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("transaction_id")
        .agg(
            F.max(F.when(of("request"), F.struct("record_id", "url", "date"))).alias("request"),
            F.max(F.when(of("response", "revisit"), F.struct("record_id", "record_type", "url", "date", "payload_digest", "payload_bytes", "digest_ok"))).alias("response"),
            F.max(F.when(of("metadata"), F.struct("record_id", "page_id", "payload_bytes", "refers_to"))).alias("metadata"),
        )
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return assemble(read_records(spark, path)).select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )
