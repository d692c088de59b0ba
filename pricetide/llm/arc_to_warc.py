"""Legacy ARC archives to WARC: parse version 1 and 2 records, synthesise WARC records, read them.

ARC's URL record line has, in version 1, five fields (URL, IP address, date, type, length) and in
version 2 ten (URL, IP address, date, type, result code, checksum, location, offset, file name,
length). The declared length, not any delimiter, ends a record, so bodies may hold anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import scratch_path

#: Fields of the two versions' record lines.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Records that a file holds at most; a reader has one file in memory.
FILE_RECORDS = 500
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")
_SPACE = re.compile(r"[\s\x00-\x20]")


class ArchiveError(ValueError):
    """A record line or length that doesn't parse."""


def arc_header(version: int, name: str, when: datetime) -> bytes:
    """The version block with which an ARC file begins."""
    fields = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename"}[f] for f in FIELDS[version])
    body = f"{version} 0 archive\n{fields}\n".encode()
    date = when.strftime("%Y%m%d%H%M%S")
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += f" 200 - - 0 {name} {len(body)}" if version == 2 else f" {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, when: datetime, body: bytes, offset: int, name: str) -> bytes:
    """One ARC record; blanks in the URL, which the line can't hold, are percent-encoded."""
    safe = _SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    line = f"{safe} 0.0.0.0 {when:%Y%m%d%H%M%S} text/html"
    line += f" 200 - - {offset} {name} {len(body)}" if version == 2 else f" {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_records(data: bytes) -> Iterator[dict[str, Any]]:
    """The records of an ARC file after its version block, each with its parsed line and body.

    The block's first line says the version. A line with other than the version's number of
    fields, or a length beyond the data, is an ArchiveError.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no line end after byte {at}")
        parts = data[at:end].decode().split(" ")
        if not parts[-1].isdigit():
            raise ArchiveError(f"no length at byte {at}")
        size = int(parts[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ArchiveError(f"the record at byte {at} ends early")
        if not version:
            if not parts[0].startswith("filedesc://") or body[:1] not in (b"1", b"2"):
                raise ArchiveError("no version block")
            version = int(body[:1])
        else:
            if len(parts) != len(FIELDS[version]):
                raise ArchiveError(f"{len(parts)} fields at byte {at} of version {version}")
            row: dict[str, Any] = dict(zip(FIELDS[version], parts, strict=True))
            yield row | {"version": version, "at": at, "body": body}
        at = end + 1 + size


def record_id(url: str, date: str, digest: str, key: str) -> str:
    """A WARC-Record-ID that the same record always gets."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {digest} {key}')}>"


def sha1_field(digest: str) -> str:
    """WARC's labelled base-32 form of a hexadecimal SHA-1."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_headers(row: dict[str, Any]) -> list[tuple[str, str]]:
    """The header fields of a record made from an ARC record.

    `row` has url, date (14 digits), type, digest, size, key, id, and for a revisit the id,
    URI and date of the record that it refers to and that record's key.
    """
    when = datetime.strptime(row["date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    out = [
        ("WARC-Type", "revisit" if row["refers_id"] else "response"),
        ("WARC-Record-ID", row["id"]),
        ("WARC-Date", f"{when:%Y-%m-%dT%H:%M:%SZ}"),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", sha1_field(row["digest"])),
        ("X-Payload-Length", str(row["size"])),
        ("X-Page-ID", row["key"]),
        ("Content-Type", row["type"]),
    ]
    if row["refers_id"]:
        out += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", row["refers_id"]),
            ("X-Refers-To-Page-ID", row["refers_key"]),
        ]
    return out


def warc_record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A whole WARC record but for its last line end."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ArchiveError(f"the record at byte {at} doesn't end where it says")
        yield headers, body
        at = end + 8 + size


RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)


def write_arc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", records: int = 500
) -> None:
    """Write pages as ARC files in compressed Parquet rows (name, version, keys, data), for tests
    and for the query: one row is one file of up to `records` pages, versions 1 and 2 in turn.

    The date is made from the page's id, so that the files are the same in every run.
    """
    epoch = datetime(2000, 1, 1, tzinfo=UTC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for whole in batches:
            for first in range(0, whole.num_rows, records):
                batch = whole.slice(first, records)
                number += 1
                version, name = 1 + number % 2, f"legacy-{number}.arc"
                data = bytearray(arc_header(version, name, epoch))
                keys = []
                for key, address, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    seconds = int.from_bytes(hashlib.sha1(str(key).encode()).digest()[:4], "big") % (20 * 365 * 86400)
                    data += arc_record(version, address or "", epoch + timedelta(seconds=seconds), (body or "").encode(), len(data), name)
                    keys.append(None if key is None else str(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([version], pa.int32()), pa.array([keys], pa.list_(pa.string())), pa.array([bytes(data)])],
                    ["name", "version", "keys", "data"],
                )

    rows = pages.select(F.col(page_id).cast("string"), url, html)
    schema = "name string, version int, keys array<string>, data binary"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def parse_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC files (name, keys, data), with what their WARC records need.

    `keys` names the records of a file in order (null where a record has no name).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for key, record in zip(keys, arc_records(data.as_py()), strict=True):
                    digest = hashlib.sha1(record["body"]).hexdigest()
                    rows.append(
                        {
                            "key": key,
                            "url": record["url"],
                            "date": record["date"],
                            "type": record["type"],
                            "version": record["version"],
                            "digest": digest,
                            "size": len(record["body"]),
                            "id": record_id(record["url"], record["date"], digest, str(key)),
                            "body": record["body"].decode(),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_RECORD)

    return archives.select("keys", "data").mapInArrow(run, RECORD)


ARROW_RECORD = pa.schema(
    [
        ("key", pa.string()),
        ("url", pa.string()),
        ("date", pa.string()),
        ("type", pa.string()),
        ("version", pa.int32()),
        ("digest", pa.string()),
        ("size", pa.int64()),
        ("id", pa.string()),
        ("body", pa.string()),
    ]
)


def _payload(digest: str, size: str) -> F.Column:
    """The name under which records with equal payloads meet."""
    return F.concat_ws(":", digest, F.col(size).cast("string"))


def with_referred(records: DataFrame, key_type: T.DataType, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records with the id and key of the response that a revisit refers to, else null.

    Of records with equal payloads of at least `least_bytes`, that with the largest key is the
    response. Rows that repeat its key are responses too. A record without a key never is one
    if another has a key, and if none has, all are responses. Records with smaller payloads,
    of which very many can be equal, don't meet in the join: each has a key of its own there.
    """
    ordered = F.col("key").cast(key_type)
    large = F.col("size") >= least_bytes
    best = (
        records.where(large)
        .groupBy("digest", "size")
        .agg(F.max(F.struct(ordered.alias("order"), F.col("key"), F.col("id"))).alias("best"), F.count("*").alias("copies"))
        .where("copies > 1 AND best.key IS NOT NULL")
        .select(_payload("digest", "size").alias("match"), F.col("best.key").alias("refers_key"), F.col("best.id").alias("refers_id"))
    )
    # An id never begins as a digest does, so it matches nothing.
    keyed = records.withColumn("match", F.when(large, _payload("digest", "size")).otherwise(F.col("id")))
    joined = keyed.join(best, "match", "left").drop("match")
    revisit = F.col("refers_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_key"))
    return joined.withColumns({c: F.when(revisit, F.col(c)) for c in ("refers_key", "refers_id")})


def write_warc(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write records as gzip-compressed WARC files; a revisit's payload is left out.

    The text sink writes each record and the line end after it, so a file is a plain run of
    WARC records.
    """
    fields = ["key", "url", "date", "type", "digest", "size", "id", "refers_id", "refers_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            bodies = batch.column("body")
            for at, row in enumerate(batch.select(fields).to_pylist()):
                row["key"] = "" if row["key"] is None else row["key"]
                body = b"" if row["refers_id"] else bodies[at].as_py().encode()
                out.append(warc_record(warc_headers(row), body).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = records.select(*fields, "body").mapInArrow(run, "value string")
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", file_records
    ).text(path)


PAGE = "key string, payload_digest string, payload_bytes long, record_type string, refers_key string, body_ok boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the WARC files under `path` say of each page; `body_ok`: the stored payload has the
    digest and length that its header declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, body in warc_records(gzip.decompress(content.as_py())):
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(headers["X-Payload-Length"])
                    whole = headers["WARC-Type"] == "response"
                    rows.append(
                        {
                            "key": headers["X-Page-ID"] or None,
                            "payload_digest": digest,
                            "payload_bytes": size,
                            "record_type": headers["WARC-Type"],
                            "refers_key": headers.get("X-Refers-To-Page-ID"),
                            "body_ok": len(body) == size and hashlib.sha1(body).hexdigest() == digest if whole else not body,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_PAGE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, PAGE)


ARROW_PAGE = pa.schema(
    [
        ("key", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("record_type", pa.string()),
        ("refers_key", pa.string()),
        ("body_ok", pa.bool_()),
    ]
)


def convert_archives(archives: DataFrame, path: str, key_type: T.DataType) -> None:
    """ARC files (name, keys, data) to WARC files under `path`.

    Identifiers are UUIDs of URL, date, digest and key; types, dates and lengths are those of
    the ARC lines; digests are those of the payloads. Records with equal payloads become
    revisits as `with_referred` says. Empty input writes no record.
    """
    write_warc(with_referred(parse_arc(archives), key_type), path)


def archive_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write pages as ARC files, convert these to WARC files, and read the WARC files back.

    A row (page_id, payload_bytes, payload_digest, record_type, refers_to, body_ok) for each
    page. The payload is the html in UTF-8; null is empty. A null URL becomes "-". Pages that
    repeat an id, and null ids, are records of their own; null ids are ordered before all
    others. Other columns of `pages` play no part.
    """
    spark = pages.sparkSession
    key_type = pages.schema[page_id].dataType
    legacy, modern = scratch_path(spark), scratch_path(spark)
    write_arc(pages, legacy, page_id, url, html)
    convert_archives(spark.read.parquet(legacy), modern, key_type)
    read = read_warc(spark, modern)
    return read.select(
        F.col("key").cast(key_type).alias(page_id),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_key").cast(key_type).alias("refers_to"),
        "body_ok",
    )
