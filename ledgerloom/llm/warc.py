"""Web archives: ARC writer and reader, conversion of ARC records to WARC, WARC writer and reader.

Archive files are written by Spark's text writer, whose line end is the records' separator, and read as whole
files by Spark's binary reader, so they work in any store Spark works in. A file holds at most
``per_file`` records of up to ``LARGE_BYTES`` after its first, descriptive one; larger payloads go to files of their own, of as
many records as fit ``FILE_BYTES`` if all were as large as the largest. That bounds what a task holds in memory.

The reader of ARC takes the version from the file's version block (1: url, address, date, type, length; 2: also
result code, checksum, location, offset, file name) and finds records by their declared lengths. The converter
derives record ids from the page, ISO timestamps from the 14-digit ones, the type from a payload seen before or not,
and SHA-1 payload digests. Readers check every declared length and digest and raise ``ValueError``.

Edge cases: a null or empty payload is an empty response; a null url is ``unknown:``; white space in urls is
escaped; equal payloads of ``REVISIT_BYTES`` and more are one response, of the largest page_id, and revisits of it; an
empty table gives no rows; repeated rows are one record each. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, remove, shared_dir, staged

RECORDS = 1000
LARGE_BYTES = 128 * 1024
FILE_BYTES = 128 * 1024 * 1024
REVISIT_BYTES = 1000
DATE = "20200101000000"
ADDRESS = "192.0.2.1"
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _write(rows: DataFrame, path: str, separator: str, per_file: int) -> None:
    w = rows.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    w.option("maxRecordsPerFile", per_file + 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/*").select("content")


def _by_size(size: Column, largest: int, per_file: int) -> list[tuple[str, Column, int]]:
    """(folder, filter, records in a file) of small and of large payloads, so that no file is much above ``FILE_BYTES``."""
    small = F.coalesce(size <= LARGE_BYTES, F.lit(True))
    out = [("small", small, min(per_file, FILE_BYTES // LARGE_BYTES))]
    return out if largest <= LARGE_BYTES else [*out, ("large", ~small, max(1, min(per_file, FILE_BYTES // largest)))]


def largest_payload(pages: DataFrame) -> int:
    return pages.agg(F.max(F.octet_length("html"))).first()[0] or 0


def _content(data: bytes) -> bytes:
    """Of a gzip file of any number of members."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        if not d.eof:
            raise ValueError("cut gzip file")
        data = d.unused_data
    return b"".join(out)


def _led(batches: Iterator[pa.RecordBatch], lead: str, per_file: int) -> Iterator[pa.RecordBatch]:
    """The rows, with a leading one before every ``per_file`` of them, as files begin there."""
    first, room = pa.RecordBatch.from_arrays([pa.array([lead])], names=["value"]), 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if not room:
                yield first
                room = per_file
            n = min(room, batch.num_rows - at)
            yield batch.slice(at, n)
            at, room = at + n, room - n


def version_block(version: int) -> str:
    text = f"{version} 0 ledgerloom\n{_FIELDS[version]}\n"
    more = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc {ADDRESS} {DATE} text/plain{more} {len(text)}\n{text}"


def arc_record(version: int, page_id: int, url: str | None, html: str | None) -> str:
    body = html or ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body.encode())}\r\nX-Page-Id: {page_id}\r\n\r\n"
    name = re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0]), url or "unknown:") or "unknown:"
    size = len(head) + len(body.encode())
    more = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"{name} {ADDRESS} {DATE} text/html{more} {size}\n{head}{body}"


def write_arc(pages: DataFrame, path: str, per_file: int = RECORDS) -> None:
    """The pages as legacy archives; files of odd partitions are version 2."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch], per_file: int) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2

        def rows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, per_file):
                    part = batch.slice(k, per_file)
                    out = [arc_record(version, *x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

        yield from _led(rows(), version_block(version), per_file)

    for name, own, n in _by_size(F.octet_length("html"), largest_payload(pages), per_file):
        rows = pages.select("page_id", "url", "html").where(own).mapInArrow(lambda batches, n=n: run(batches, n), "value string")
        _write(rows, f"{path}/{name}", "\n", n)


def arc_records(data: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(url, address, date, type, content) of the records of an ARC file after its version block."""
    at, version = 0, 0
    while at < len(data):
        end = data.index(b"\n", at)
        head = data[at:end].decode().split(" ")
        if not version:
            size = int(head[-1])
            lines = data[end + 1 : end + 1 + size].decode().split("\n")
            version = int(lines[0].split(" ")[0])
            if not head[0].startswith("filedesc:") or version not in _FIELDS or lines[1] != _FIELDS[version]:
                raise ValueError("not a version block")
        elif len(head) != len(_FIELDS[version].split(" ")):
            raise ValueError(f"a header line of version {version} has {len(head)} fields")
        else:
            size = int(head[-1])
            yield head[0], head[1], head[2], head[3], data[end + 1 : end + 1 + size]
        at = end + 1 + size
        if data[at : at + 1] != b"\n":
            raise ValueError(f"the record before byte {at} has not its declared length")
        at += 1


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    return head + gap, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), body


_CONVERTED = {
    "page_id": pa.int64(), "uri": pa.string(), "address": pa.string(), "date": pa.string(), "head": pa.string(), "payload": pa.binary(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(),
}


def converted(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC archives with the WARC fields that need no other record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out: dict[str, list] = {k: [] for k in _CONVERTED}
                for uri, address, date, _, content in arc_records(_content(data.as_py())):
                    head, fields, body = _http(content)
                    row = (int(fields["X-Page-Id"]), uri, address, f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z", head.decode(), body, len(body), hashlib.sha1(body).hexdigest())
                    for k, v in zip(_CONVERTED, row, strict=True):
                        out[k].append(v)
                yield arrow(_CONVERTED, out)

    schema = "page_id long, uri string, address string, date string, head string, payload binary, payload_bytes long, payload_digest string"
    return _files(spark, path).mapInArrow(run, schema)


def _urn(page_id: str) -> Column:
    """A record id that follows from the page."""
    h = F.md5(F.concat(F.lit("page:"), F.col(page_id).cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS, largest: int | None = None) -> None:
    """Converted records as WARC archives: a response for each payload, revisits for others that are equal to it. largest: of the payloads, if known.

    Only digests that occur twice and more go to the side of the join that finds them; it is a written table, so Spark
    broadcasts it if it is below its size threshold and shuffles otherwise.
    """
    equal = records.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    equal = staged(equal.where("n > 1").drop("n"), "digests")
    own = records.join(equal, ["payload_digest", "payload_bytes"], "left").withColumn("revisit", F.coalesce(F.col("keep") != F.col("page_id"), F.lit(False)))
    # of a revisit, the HTTP header is kept, and with it the payload's length
    block = F.when(F.col("revisit"), F.col("head")).otherwise(F.concat("head", F.col("payload").cast("string")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = [
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn("page_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("address")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _urn("keep")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(F.col("block")).cast("string")),
        F.lit("\r\n"),
    ]
    rows = own.withColumn("block", block).select("payload_bytes", F.concat(*head, F.col("block")).alias("value"))
    if largest is None:
        largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    about = "software: ledgerloom\r\nformat: WARC File Format 1.0\r\n"
    info = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, about)}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}"
    for name, fits, n in _by_size(F.col("payload_bytes"), largest, per_file):
        _write(rows.where(fits).select("value").mapInArrow(lambda batches, n=n: _led(batches, info, n), "value string"), f"{path}/{name}", "\r\n\r\n", n)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        at, size = end + 4, int(fields["Content-Length"])
        block = data[at : at + size]
        at += size
        if not version.startswith("WARC/") or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} has not its declared length")
        at += 4
        yield fields, block


_READ = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers_id": pa.string(), "uri": pa.string()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, record_id, refers_id, uri) of responses and revisits; digests of responses are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out: dict[str, list] = {k: [] for k in _READ}
                for fields, block in warc_records(_content(data.as_py())):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, http, body = _http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"wrong digest of {fields['WARC-Record-ID']}")
                    n = len(body) if kind == "response" else int(http["Content-Length"])
                    row = (int(http["X-Page-Id"]), n, digest, kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"])
                    for k, v in zip(_READ, row, strict=True):
                        out[k].append(v)
                yield arrow(_READ, out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string, uri string"
    return _files(spark, path).mapInArrow(run, schema)


def archived(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """Writes the pages as ARC, converts the archives to WARC and reads those back: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. The ARC files go once they are converted, the WARC files once they are read back.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/ledgerloom/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", per_file)
    write_warc(converted(spark, f"{base}/arc"), f"{base}/warc", per_file, largest_payload(pages))
    remove(spark, f"{base}/arc")
    found = staged(read_warc(spark, f"{base}/warc").drop("uri"), "archived")
    remove(spark, base)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    target = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("page_id").alias("refers_to"))
    revisits = found.where("record_type = 'revisit'").join(target, "refers_id", "left").select(*columns, "refers_to")
    return found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
