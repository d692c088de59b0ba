from __future__ import annotations

import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import types as T

from pricetide.llm.arc_to_warc import (
    ArchiveError,
    arc_header,
    arc_record,
    arc_records,
    archive_pages,
    warc_record,
    warc_records,
    with_referred,
)

WHEN = datetime(2003, 4, 5, 6, 7, 8, tzinfo=UTC)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_length(version):
    bodies = [b"", b"plain", b"http://x 0.0.0.0 20030405060708 text/html 4\nfake\n", "é\r\n\n\x00".encode()]
    data = arc_header(version, "a.arc", WHEN)
    for n, body in enumerate(bodies):
        data += arc_record(version, f"http://h/{n} b\n", WHEN, body, len(data), "a.arc")
    found = list(arc_records(data))
    assert [r["body"] for r in found] == bodies and {r["version"] for r in found} == {version}
    assert found[1]["url"] == "http://h/1%20b%0A" and found[1]["date"] == "20030405060708"
    with pytest.raises(ArchiveError):
        list(arc_records(data[:-4]))
    with pytest.raises(ArchiveError):
        list(arc_records(data.replace(b" text/html ", b" ", 1)))
    with pytest.raises(ArchiveError):
        list(arc_records(b"http://x 0.0.0.0 20030405060708 text/html 1\na\n"))


def test_warc_records_by_declared_length():
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 5000]
    data = b"".join(warc_record([("WARC-Type", "response"), ("N", str(n))], b) + b"\r\n" for n, b in enumerate(bodies))
    assert [b for _, b in warc_records(data)] == bodies
    with pytest.raises(ArchiveError):
        list(warc_records(data[:-1]))


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body]
        best = max((p for p in same if p is not None), default=None)
        revisit = len(body) >= 1000 and best is not None and page != best
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None, True))
    return sorted(out, key=str)


def test_pages_match_brute_force(spark):
    big, other = "<p>é\r\nWARC/1.1\n" * 200, "<b>\n\n" * 300
    rows = [
        (1, "http://a", big), (9, "http://b c", big), (3, None, big), (4, "http://d", None), (5, "http://e", ""),
        (6, "http://f", "small"), (7, "http://g", "small"), (8, "http://h", other), (8, "http://h", other), (2, "http://i", other),
        (None, "http://j", other), (None, "http://k", "x" * 1500), (11, "http://l", "y" * 999), (12, "http://m", "y" * 999),
        (13, "u\nv", "z" * 300_000), (10, "http://n", "é" * 500), (14, "http://o", "é" * 500),
    ]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, key string, size int")
    found = archive_pages(pages).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_ok")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == brute(rows)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_pages(pages).collect() == []


def test_small_records_have_no_common_key_in_the_join(spark):
    shape = "key string, digest string, size long, id string"
    rows = [(str(i), "same", 3, f"<urn:{i}>") for i in range(40)] + [("1", "big", 2000, "<urn:a>"), ("2", "big", 2000, "<urn:b>")]
    found = with_referred(spark.createDataFrame(rows, shape), T.LongType())
    assert [(r["id"], r["refers_key"], r["refers_id"]) for r in found.where("refers_id IS NOT NULL").collect()] == [("<urn:a>", "2", "<urn:b>")]
    assert found.count() == 42 and found.columns == ["key", "digest", "size", "id", "refers_key", "refers_id"]
