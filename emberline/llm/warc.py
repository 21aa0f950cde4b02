"""WARC archives with revisit resolution.

`write` decides on headers alone: digests of payloads of at least `least` bytes are counted with partial aggregation, and
those that repeat are joined back to the headers. A digest may be that of a third of all pages: only headers meet on it,
in a join of two written tables, which adaptive execution splits. The revisits found are a table too; it is joined to
the pages by page and digest, without a shuffle of the pages where it is small, otherwise with one that no digest can skew.

Each page is written with fresh headers: a response with its payload or a revisit that refers to it. `read` takes archives
apart by Content-Length; lines of a file reach the parser as they are decompressed, so files may be of any size and a
task holds one record. `resolve` joins revisits to the responses they repeat, by digest.

Defined results: null or empty html is an empty payload; null url is empty; very long payloads are written whole; of
repeated rows with the largest page_id each is a response; null page_ids come before all others; an empty table writes no
archive and gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import shared_dir, stored

CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id string, uri string, type string, payload_digest string, payload_bytes bigint, record_id string, refers_to_id string"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page.cast("string"), F.lit("-")), F.lit("|"), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in values are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write deduplicated archives: gzip files of records, each file one stream."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page).alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    again = revisits(rows.filter(F.col("n") >= least).select("page", "url", "digest"))
    rows = rows.join(again, rows["page"].eqNullSafe(again["again"]) & (rows["digest"] == again["of"]), "left")
    again = F.col("of").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Page-ID", F.col("page").cast("string")),
        _line("WARC-Profile", F.when(again, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("first_page"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("first_url"))),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        F.lit("Content-Length: "),
        (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n"))).cast("string"),
        F.lit(CRLF * 2),
    )
    record = F.concat(head, http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.options(lineSep=CRLF * 2, compression="gzip", maxRecordsPerFile=per_file).text(folder)


def revisits(heads: DataFrame) -> DataFrame:
    """(again, of, first_page, first_url) of the headers (page, url, digest) that repeat the one with the largest page."""
    heads = stored(heads)
    firsts = heads.groupBy("digest").agg(F.max(F.struct("page", "url")).alias("first"), F.count("*").alias("records")).filter("records > 1")
    firsts = stored(firsts.select("digest", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url")))
    found = heads.join(firsts, "digest").filter(~F.col("page").eqNullSafe(F.col("first_page")))
    return stored(found.select(F.col("page").alias("again"), F.col("digest").alias("of"), "first_page", "first_url").distinct())


class _Lines(io.RawIOBase):
    """The bytes of lines as they come."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.parts = (b"".join(x + b"\n" for x in part.to_pylist()) for b in batches for part in _small(b.column(0).cast(pa.binary())))
        self.held, self.at = b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.at >= len(self.held):
            if (held := next(self.parts, None)) is None:
                return 0
            self.held, self.at = held, 0
        n = min(len(buffer), len(self.held) - self.at)
        buffer[:n] = memoryview(self.held)[self.at : self.at + n]
        self.at += n
        return n


def _small(lines: pa.Array, at_once: int = 256) -> Iterator[pa.Array]:
    return (lines.slice(i, at_once) for i in range(0, len(lines), at_once))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; a stream that ends within one is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(n := int(head["content-length"]))
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        yield head, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; a response's digest and bytes are those of the payload that was read, a revisit's digest is as stated."""

    def parse(batches):
        rows: list[tuple] = []
        for head, block in records(io.BufferedReader(_Lines(batches), 1 << 20)):
            kind, digest, size = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:"), None
            if kind == "response":
                body = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                digest, size = hashlib.sha1(body).hexdigest(), len(body)
            rows.append((head.get("x-page-id"), head.get("warc-target-uri", ""), kind, digest, size, head.get("warc-record-id"), head.get("warc-refers-to")))
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return spark.read.text(folder, lineSep="\n").mapInArrow(parse, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])


def resolve(rows: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits get them from their response."""
    responses = rows.filter("type = 'response'")
    first = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("first_bytes"), F.max("payload_digest").alias("first_digest"))
    revisits = rows.filter("type = 'revisit'").join(first, "refers_to_id", "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))


def round_trip(pages: DataFrame, page: str = "page_id", **options) -> DataFrame:
    """Write pages to new archives, read them back and resolve revisits."""
    spark = pages.sparkSession
    write(pages, folder := new_folder(spark), page=page, **options)
    kind = pages.schema[page].dataType
    out = resolve(read(spark, folder))
    return out.select(F.col("page_id").cast(kind).alias(page), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
