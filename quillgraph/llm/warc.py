"""Legacy archive converter: ARC records of either version become equivalent WARC records.

An ARC file is a run of records, each a header line of space-separated fields and as many bytes as the last field
declares, then a line feed. Version 1 lines have five fields (URL, IP, date, content type, length); version 2 lines
have ten (result code, checksum, location, offset and file name before the length). The first record (``filedesc:``)
names the version and becomes ``warcinfo``. Conversion synthesises the identifier (a version-8 UUID that holds all 64 bits
of the page id and a part of the payload's digest), the timestamp (14 digits to ISO 8601), the type (``response`` for HTTP
blocks, else ``resource``) and the SHA-1 digests of block and payload; equal payloads become ``revisit``.

``write_warc`` writes the records as gzip-compressed WARC files with Spark's text writer (the separator between rows is
the end mark of a record; strings keep the bytes of the payload as they are), so any store that Spark can write will do.
A file holds at most ``per_file`` records and is compressed as a whole. ``read_warc`` reads them back by their declared
lengths; sizes and digests are worked out again from what was read, and a record that doesn't match what it declares is an
error. Revisits have no payload: their size is that of the HTTP header which they keep, their digest what they declare.

Edge cases: null html is an empty payload; a null or odd url is escaped into one field; null page ids have a mark of their
own in the identifier; equal page ids give equal rows; records shorter than ``revisit_from`` bytes are always ``response``;
bytes that end before a declared length raise ``ValueError``; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, shared_folder, slices, small_batches

CRLF = "\r\n"
ARC_DATE = "20240101000000"
ARCHIVES = "name string, version int, archive binary, page_ids array<bigint>, refers_to array<bigint>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string, record_id string"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    status: int | None
    block: bytes


def arc_record(url: str, date: str, content_type: str, block: bytes, version: int, ip: str = "0.0.0.0", offset: int = 0, name: str = "-") -> bytes:
    """One ARC record; version 2 has the result code and checksum fields as well."""
    fields = [quote(url, safe="%/:=&?~#+!$,;'@()*[]-._"), ip, date, content_type]
    if version == 2:
        status = re.match(rb"HTTP/\S+ (\d{3})", block)
        fields += [status[1].decode() if status else "-", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return f"{' '.join([*fields, str(len(block))])}\n".encode() + block + b"\n"


def arc_header(version: int, name: str) -> bytes:
    """The record that opens a file: it says the version and names the fields of the lines that follow."""
    fields = "URL IP-address Archive-date Content-type" + (" Result-code Checksum Location Offset Filename" if version == 2 else "") + " Archive-length\n"
    block = f"{version} 0 quillgraph\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain " + (f"200 - - 0 {name} " if version == 2 else "")
    return f"{line}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, without the one that opens it. Lengths are taken as declared."""
    at, version = 0, 1
    while at < len(data):
        if data[at] == 10:  # blank line between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line without an end")
        fields = data[at:end].decode("utf-8", "replace").split(" ")
        size = int(fields[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record of {size} bytes ends after {len(block)}")
        at = end + 1 + size
        if fields[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            continue
        if len(fields) != (10 if version == 2 else 5):
            raise ValueError(f"{len(fields)} fields in a line of version {version}")
        status = int(fields[4]) if version == 2 and fields[4].isdigit() else None
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], status, block)


def record_uuid(page_id: int | None, digest: str) -> str:
    """Version-8 UUID: 57 bits of the digest, a mark for null, and the 64 bits of the id."""
    taken, page = int(digest[:15], 16) >> 3, (page_id or 0) & ((1 << 64) - 1)
    high = (taken >> 9 << 16) | 0x8000 | (taken & 0x1FF) << 3 | (page_id is None) << 2 | page >> 62
    return f"urn:uuid:{uuid.UUID(int=(high << 64) | (0b10 << 62) | (page & ((1 << 62) - 1)))}"


def id_in_uuid(urn: str) -> int | None:
    whole = uuid.UUID(urn.strip("<>")[9:]).int
    page = (whole >> 64 & 3) << 62 | whole & ((1 << 62) - 1)
    return None if whole >> 66 & 1 else page - (page >> 63 << 64)


def http_block(payload: bytes) -> bytes:
    return CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]).encode() + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split(CRLF)[1:] if ": " in x), payload


def warc_record(kind: str, identifier: str, date: str, content_type: str, block: bytes, **more: str) -> bytes:
    """One record, without the two line ends that close it."""
    d = date.ljust(14, "0")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", "",
    ]
    return CRLF.join(lines).encode() + block


def warc_info(name: str, version: int) -> bytes:
    block = f"software: quillgraph\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {version}\r\n".encode()
    return warc_record("warcinfo", record_uuid(None, hashlib.sha1(name.encode()).hexdigest()), ARC_DATE, "application/warc-fields", block, WARC_Filename=name)


def to_warc(record: ArcRecord, page_id: int | None = None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record. With ``refers_to`` it is a revisit without payload."""
    http = record.block.startswith(b"HTTP/")
    payload = split_http(record.block)[1] if http else record.block
    digest = hashlib.sha1(payload).hexdigest()
    more = {"WARC_Target_URI": record.url, "WARC_IP_Address": record.ip, "WARC_Payload_Digest": f"sha1:{digest}"}
    kind, block, content = "response" if http else "resource", record.block, "application/http; msgtype=response" if http else record.content_type
    if refers_to is not None:
        kind, block = "revisit", record.block[: len(record.block) - len(payload)]
        more |= {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": f"<{record_uuid(refers_to, digest)}>"}
    return warc_record(kind, record_uuid(page_id, digest), record.date, content, block, **more)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        start, size = end + 4, int(head["Content-Length"])
        if start + size > len(data):
            raise ValueError("record ends too early")
        yield head, data[start : start + size]
        at = start + size + 4


#: Bytes of pages in one ARC file, and (at the size of the largest page) of records in one WARC file: each is one value of a row.
ARCHIVE_BYTES, FILE_BYTES = 32 << 20, 256 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where the values of ``column`` pass ``most`` bytes together; a longer value stands alone."""
    for batch in batches:
        total, lo = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total + n > most and i > lo:
                yield batch.slice(lo, i - lo)
                total, lo = 0, i
            total += n
        if batch.num_rows > lo:
            yield batch.slice(lo)


def arc_archives(pages: DataFrame, per_archive: int = 256) -> DataFrame:
    """ARC files of the pages, versions by turns; ids and ``refers_to`` of the pages ride along in order."""
    most = ARCHIVE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, part in enumerate(by_bytes(slices(batches, per_archive), "html", most)):
            version, name = 1 + turn % 2, f"pages-{TaskContext.get().partitionId()}-{turn}.arc"
            out, ids = [arc_header(version, name)], part.column("page_id").to_pylist()
            for page, url, html in zip(ids, part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                block = http_block((html or "").encode("utf-8", "surrogatepass"))
                out.append(arc_record(url or f"urn:page:{page}", ARC_DATE, "text/html", block, version, name=name))
            yield batch_of([(name, version, b"".join(out), ids, part.column("refers_to").to_pylist())], arrow_schema(ARCHIVES))

    small_batches(pages.sparkSession)
    return pages.mapInArrow(run, ARCHIVES)


def convert(archives: DataFrame) -> DataFrame:
    """(record binary): WARC records of ARC files, a ``warcinfo`` first; ``refers_to`` says, in order, what each one revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            (r,) = part.to_pylist()
            records = [to_warc(*x) for x in zip(parse_arc(r["archive"]), r["page_ids"], r["refers_to"], strict=True)]
            yield batch_of([(x,) for x in [warc_info(r["name"], r["version"]), *records]], arrow_schema("record binary"))

    return archives.mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str, per_file: int = 1000) -> None:
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def row_of(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD, from what the record holds; it must match what the record declares."""
    declared, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    http, payload = split_http(block) if block.startswith(b"HTTP/") else ({}, block)
    size, digest = (int(http["Content-Length"]), declared) if revisit else (len(payload), hashlib.sha1(payload).hexdigest())
    if digest != declared or head["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"digests of {head['WARC-Record-ID']} don't match")
    refers_to = id_in_uuid(head["WARC-Refers-To"]) if revisit else None
    return id_in_uuid(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers_to, head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Record-ID"].strip("<>")


def read_warc(spark, path: str) -> DataFrame:
    """One row per record, other than ``warcinfo``, of the WARC files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            for data in part.column("content").to_pylist():
                yield batch_of([row_of(*x) for x in parse_warc(gzip.decompress(data)) if x[0]["WARC-Type"] != "warcinfo"], arrow_schema(RECORD))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """Write the pages as WARC records by way of ARC, with revisits of equal payloads, and read the archives back.

    Only (digest, largest id) of payloads found more than once is aggregated; the join back may be split by AQE where
    one payload is very common.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    long = F.col("size") >= revisit_from
    again = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    again = rows.where(long).join(again, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    all_pages = again.unionByName(rows.where(~long).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))
    path = f"{shared_folder(spark)}/quillgraph/warc-{uuid.uuid4().hex}"
    largest = rows.agg(F.max("size")).first()[0] or 0
    write_warc(convert(arc_archives(all_pages)), path, max(1, min(1000, FILE_BYTES // (largest + 4096))))
    return read_warc(spark, path)
