from __future__ import annotations

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pricetide.sources import snapshot_files
from pricetide.sources.snapshot_files import BrokenJson, JsonStream, read_document, read_measures, read_records, records
from pricetide.sources.snapshots import explode_records
from tests.conftest import rows

KEY = "cardmarket/priceguide/onepiece/2026/08/2026-08-{:02d}.json{}"
BODIES = [
    [{"idProduct": 1}, 5, "x", {"a": {"b": [1, 2, "]}"]}}],
    {"products": [{"n": 1}], "data": [{"n": 2}]},
    {"data": {"no": 1}, "priceGuide": "text", "priceGuides": [{"n": 3}, None, [{"n": 4}]]},
    {"items": [{"n": 1}]},
    {"createdAt": "2026-08-01", "version": 1, "other": {"deep": [[{}]], "x": {}}, "products": []},
    [],
    {},
    7,
    {"products": [{"name": 'Pokémon ☃ " \\ \n', "price": -1.5e3}]},
]
BROKEN = ["", "   ", "[1,]", "[1 2]", '{"data": [1}', '{"a" 1}', "[] x", '{"data": [{"a": 1}', "{1: 2}", '["\\x"]']


def pieces(text, rng):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, 4)
        out.append(text[at : at + n])
        at += n
    return out


def test_values_over_any_cuts():
    rng = random.Random(1)
    for body in BODIES:
        text = json.dumps(body, indent=rng.choice([None, 2]), ensure_ascii=False)
        for _ in range(5):
            stream = JsonStream(pieces(text, rng))
            assert stream.value()[0] == body and stream.peek() == ""
            if isinstance(body, list):
                assert [json.loads(t) for t in JsonStream(pieces(text, rng)).elements()] == body


@pytest.mark.parametrize("text", BROKEN)
def test_broken_documents(tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    found = read_document(str(path))
    assert (found.valid, found.lists) == (False, {})
    assert (found.size, found.sha256) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    assert list(records(str(path))) == []
    with pytest.raises((json.JSONDecodeError, BrokenJson)):
        json.loads(text) if text.strip() else JsonStream([text]).take("{")


def test_unreadable_and_odd_files(tmp_path):
    (tmp_path / "cut.json.gz").write_bytes(gzip.compress(b'{"data": [1]}' * 1000)[:-20])
    (tmp_path / "latin.json").write_bytes('["é"]'.encode("latin-1"))
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf[{}]")
    assert read_document(str(tmp_path / "cut.json.gz")).sha256 is None
    assert not read_document(str(tmp_path / "latin.json")).valid
    assert list(records(str(tmp_path / "mark.json"))) == ["{}"]


@pytest.mark.parametrize("held", [0, 10, 1 << 20])
def test_large_lists_are_read_again(tmp_path, held):
    many = [{"i": i, "t": "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "x.json").write_text(json.dumps({"priceGuides": [{"no": 1}], "z": many, "data": many}))
    assert [json.loads(t) for t in records(str(tmp_path / "x.json"), held)] == many


def test_source_equals_parsing_of_bodies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot_files, "PARTITION_BYTES", 40)
    docs = []
    for i, body in enumerate(BODIES, 1):
        text = json.dumps(body, ensure_ascii=False)
        key = KEY.format(i, ".gz" if i % 2 else "")
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(gzip.compress(text.encode()) if i % 2 else text.encode())
        docs.append((key, "onepiece", text))
    (tmp_path / "cardmarket" / "notes.txt").write_text("not a snapshot")
    frame = spark.createDataFrame(docs, "key string, game_key string, body string")
    want = rows(explode_records(frame), "key", "game_key", "source_pos")
    found = read_records(spark, str(tmp_path))
    assert rows(found, "key", "game_key", "source_pos") == want
    same = found.join(explode_records(frame).withColumnRenamed("item", "other"), ["key", "source_pos"])
    assert same.filter(F.try_parse_json("item").cast("string") != F.try_parse_json("other").cast("string")).count() == 0
    measured = read_measures(spark, [str(tmp_path)])
    assert rows(measured.filter("valid"), "key") == [(k,) for k in sorted(k for k, _, _ in docs)]
    sizes = {r["key"]: (r["size"], r["sha256"], r["bare"], r["products"], r["created_at"]) for r in measured.collect()}
    for (key, _, text), body in zip(docs, BODIES, strict=True):
        products = body.get("products") if isinstance(body, dict) else None
        assert sizes[key] == (
            len(text.encode()),
            hashlib.sha256(text.encode()).hexdigest(),
            len(body) if isinstance(body, list) else None,
            len(products) if products is not None else None,
            body.get("createdAt") if isinstance(body, dict) else None,
        )
    assert rows(found.select("kind", "run_date").distinct(), "kind") == [("priceguide",)] * 4


def test_an_empty_folder(spark, tmp_path):
    assert read_records(spark, str(tmp_path)).count() == 0


def test_a_long_list_is_read_in_one_pass(tmp_path, monkeypatch):
    many = [{"i": i, "t": "é" * (i % 50)} for i in range(3000)]
    (tmp_path / "x.json").write_text(json.dumps({"priceGuides": [{"no": 1}] * 99, "data": many, "z": 1}))
    opened, original = [], snapshot_files.chunks
    monkeypatch.setattr(snapshot_files, "chunks", lambda uri: opened.append(uri) or original(uri))
    assert [json.loads(t) for t in records(str(tmp_path / "x.json"), 100)] == many
    assert len(opened) == 1
