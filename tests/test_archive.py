from __future__ import annotations

import gzip
import hashlib
import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricetide.operators import archive
from pricetide.params import definitions_frame
from pricetide.plans.audit import audit_archive
from pricetide.schemas import QUALITY
from pricetide.sources import manifests as source
from pricetide.sources.object_files import list_objects, write_objects
from tests.conftest import rows

FILE = "run_date date, game_key string, kind string, sha256 string"
D = date(2026, 7, 20)


def write_day(root, day, games=("onepiece",), body=None, run_date=None, unchanged=False):
    body = body or json.dumps({"priceGuides": [{"idProduct": 1}], "products": [{"idProduct": 1}]})
    files = []
    for game in games:
        for kind in ("priceguide", "catalogue"):
            files.append(
                {
                    "game": game,
                    "kind": kind,
                    "key": f"cardmarket/{kind}/{game}/{day:%Y}/{day:%m}/{day}.json.gz",
                    "sha256_uncompressed": hashlib.sha256(body.encode()).hexdigest(),
                    "size_uncompressed": len(body.encode()),
                    "fetched_at": f"{day}T05:00:00+00:00",
                    "headers": {"etag": "x", "server": "y"},
                    "unchanged_from_previous": unchanged,
                }
            )
    (root / f"{day}.json").write_text(
        json.dumps({"run_date": str(run_date or day), "schema_version": 1, "files": files})
    )
    return body


def read(spark, root):
    found = source.read_manifests(spark, str(root))
    return found, source.manifest_files(found)


def test_manifests_with_a_malformed_file(spark, tmp_path):
    write_day(tmp_path, D)
    (tmp_path / "2026-07-21.json").write_text("{broken")
    found, files = read(spark, tmp_path)
    assert rows(found, "path_date", "malformed") == [(D, False), (D + timedelta(days=1), True)]
    assert rows(files, "kind", "game_key") == [("catalogue", "onepiece"), ("priceguide", "onepiece")]
    pointer = source.latest_pointer(found).first()
    assert pointer.date == str(D) and len(pointer.files) == 2


def test_calendar_counts_only_days_with_the_game(spark, tmp_path):
    write_day(tmp_path, D, ("a",))
    write_day(tmp_path, D + timedelta(days=1), ("a", "b"), unchanged=True)
    _, files = read(spark, tmp_path)
    prices = spark.createDataFrame([("c", D), ("c", D), ("a", date(2020, 1, 1))], "game_key string, value_date date")
    calendar = source.archive_calendar(files, prices)
    second = D + timedelta(days=1)
    assert rows(calendar, "game_key", "value_date", "unchanged") == [
        ("a", D, False),
        ("a", second, True),
        ("b", second, True),
        ("c", D, False),
    ]
    assert source.archive_calendar(files, prices, D).count() == 2


def test_unchanged_means_the_day_before(spark):
    data = [(D, "g", "priceguide", "s1"), (D + timedelta(days=1), "g", "priceguide", "s1"), (D + timedelta(days=3), "g", "priceguide", "s1")]
    flagged = archive.unchanged_from_previous(spark.createDataFrame(data, FILE))
    assert rows(flagged, "run_date", "unchanged") == [
        (D, False),
        (D + timedelta(days=1), True),
        (D + timedelta(days=3), False),
    ]


def test_immutable_conflicts_take_the_next_free_number(spark):
    index = spark.createDataFrame(
        [("k1.json.gz", "a"), ("k2.json.gz", "a"), ("k2.conflict-1.json.gz", "x"), ("k2.conflict-3.json.gz", "x")],
        "key string, sha256 string",
    )
    candidates = spark.createDataFrame([("k0.json.gz", "a"), ("k1.json.gz", "a"), ("k2.json.gz", "b")], "key string, sha256 string")
    plan = archive.plan_immutable_writes(candidates, index)
    assert rows(plan, "key", "status", "target_key") == [
        ("k0.json.gz", "created", "k0.json.gz"),
        ("k1.json.gz", "existing", "k1.json.gz"),
        ("k2.json.gz", "conflict", "k2.conflict-2.json.gz"),
    ]


def audit(spark, root, one_index, body, start=D, end=D + timedelta(days=2), rate=0.25):
    found, files = read(spark, root)
    documents = files.select("key", F.lit(body).alias("body"))
    objects = files.select("key", "size")
    inceptions = spark.createDataFrame([("onepiece", D)], "game_key string, inception date")
    return audit_archive(
        spark, found, files, documents, objects, definitions_frame(spark, one_index),
        spark.createDataFrame([], QUALITY), inceptions, start, end, rate, "seed", 60,
    )


def test_audit_with_a_gap(spark, tmp_path, one_index):
    guide = json.dumps({"priceGuides": [{"idProduct": i} for i in range(1000)], "products": [{}]})
    for offset in (0, 1):
        write_day(tmp_path, D + timedelta(days=offset), body=guide)
    report = audit(spark, tmp_path, one_index, guide)
    assert rows(report.errors, "error") == [("2026-07-22: missing manifest",)]
    assert rows(report.coverage, "expected_days", "manifest_count") == [(3, 2)]
    assert report.sampled.count() == 1
    assert rows(report.projections, *report.projections.columns) == [(date(2026, 9, 17), date(2026, 9, 18), date(2026, 10, 1))]
    readiness = report.readiness.first()
    assert (readiness.state, readiness.days_remaining) == ("accumulating", 58)
    assert rows(report.summary, *report.summary.columns) == [("fail", 1, 4, 1, 4, "accumulating")]
    assert report.warnings.count() == 0


def test_audit_finds_wrong_dates_and_content(spark, tmp_path, one_index):
    write_day(tmp_path, D, run_date=D + timedelta(days=9))
    report = audit(spark, tmp_path, one_index, "[1]", end=D, rate=1.0)
    text = " | ".join(r[0] for r in rows(report.errors, "error"))
    assert "manifest run_date is 2026-07-29" in text
    assert "sha256 mismatch" in text and "uncompressed size mismatch" in text
    assert "price guide below 1000 records" in text
    with pytest.raises(ValueError):
        audit_archive(spark, None, None, None, None, None, None, None, D, D, 1.0, "s", 0)


def test_hash_and_size_of_non_ascii_bodies(spark):
    body = '[{"name": "Pokémon ☃"}]'
    files = spark.createDataFrame(
        [(D, "g", "catalogue", "k", hashlib.sha256(body.encode()).hexdigest(), len(body.encode()))],
        "run_date date, game_key string, kind string, key string, sha256 string, size bigint",
    )
    docs = spark.createDataFrame([("k", body)], "key string, body string")
    assert archive.content_errors(files, docs).count() == 0


def test_structure_errors(spark, tmp_path):
    write_day(tmp_path, D)
    _, files = read(spark, tmp_path)
    files = files.withColumn("run_date", F.to_date("run_date"))
    assert archive.structure_errors(files).count() == 0
    broken = files.withColumn("size", F.lit(0)).withColumn("key", F.lit("x")).withColumn("sha256", F.lit("1"))
    assert archive.structure_errors(broken.withColumn("fetched_at", F.lit(None).cast("string"))).count() == 8


def test_object_listing_reads_no_bodies(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    (tmp_path / "a" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a" / "deep" / "er" / "y.bin").write_bytes(b"1")
    (tmp_path / "top.bin").write_bytes(b"")
    listed = list_objects(spark, str(tmp_path))
    assert rows(listed, "key", "size") == [("a/deep/er/y.bin", 1), ("a/x.bin", 5), ("top.bin", 0)]
    before = dict(rows(listed, "key", "etag"))
    (tmp_path / "a" / "x.bin").write_bytes(b"123456")
    after = dict(rows(list_objects(spark, str(tmp_path), depth=2), "key", "etag"))
    assert {k for k in before if before[k] != after[k]} == {"a/x.bin"}


def test_objects_are_written_once(spark, tmp_path):
    lines = spark.createDataFrame([("b/two.json.gz", 1, "]"), ("b/two.json.gz", 0, "["), ("one", 0, "é")], "key string, pos int, text string")
    first = rows(write_objects(lines, str(tmp_path)), "key", "size", "sha256", "status")
    assert [(k, n, s) for k, n, _, s in first] == [("b/two.json.gz", 4, "created"), ("one", 3, "created")]
    assert gzip.decompress((tmp_path / "b" / "two.json.gz").read_bytes()) == b"[\n]\n"
    assert first[1][2] == hashlib.sha256("é\n".encode()).hexdigest()
    again = write_objects(lines.withColumn("text", F.replace("text", F.lit("é"), F.lit("e"))), str(tmp_path))
    assert rows(again, "key", "status") == [("b/two.json.gz", "existing"), ("one", "conflict")]
    assert (tmp_path / "one").read_text() == "é\n"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["one", "two.json.gz"]


def test_audit_opens_only_sampled_files(spark, tmp_path, one_index):
    guide = json.dumps({"priceGuides": [{"idProduct": i} for i in range(1000)], "products": [{}]})
    for offset in range(3):
        write_day(tmp_path, D + timedelta(days=offset), body=guide)
    found, files = read(spark, tmp_path)
    keys = [r["key"] for r in files.select("key").collect()]
    sampled = {r[0] for r in archive.sample_files(files, 0.3, "seed").collect()}
    store = tmp_path / "store"
    for key in keys:
        (store / key).parent.mkdir(parents=True, exist_ok=True)
        # Files outside the sample are broken: who opens them reports it.
        (store / key).write_bytes(gzip.compress(guide.encode()) if key in sampled else b"broken")
    report = audit_archive(
        spark, found, files, str(store), files.select("key", "size"), definitions_frame(spark, one_index),
        spark.createDataFrame([], QUALITY), spark.createDataFrame([("onepiece", D)], "game_key string, inception date"),
        D, D + timedelta(days=2), 0.3, "seed",
    )
    assert report.errors.count() == 0
    assert {r[0] for r in rows(report.measured, "key")} == sampled and len(sampled) == 2
    documents = files.select("key", F.lit(guide).alias("body"))
    assert {r[0] for r in rows(archive.sampled_bodies(documents, archive.sample_files(files, 0.3, "seed"), "seed"), "key")} == sampled


def test_sample_is_stable_and_sized(spark):
    keys = spark.range(100).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    first = rows(archive.sample_files(keys, 0.051, "s"), "key")
    assert len(first) == 6
    assert first == rows(archive.sample_files(keys.repartition(7), 0.051, "s"), "key")
    assert archive.sample_files(keys.limit(0), 0.5, "s").count() == 0


def test_few_files_are_read_by_several_tasks(spark, tmp_path):
    from pricetide.sources.snapshot_files import key_records, measure_keys

    keys = [f"cardmarket/catalogue/onepiece/2026/08/2026-08-{d:02}.json" for d in range(1, 13)]
    for key in keys:
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_text('{"products": [{"idProduct": 1}]}')
    named = spark.createDataFrame([(k,) for k in keys], "key string")
    for read in (measure_keys(named, str(tmp_path)), key_records(named, str(tmp_path))):
        tasks = read.select("key", F.spark_partition_id().alias("task")).collect()
        assert sorted(r["key"] for r in tasks) == keys
        assert len({r["task"] for r in tasks}) > 1


def test_tasks_read_equally_many_files(spark, tmp_path):
    from pricetide.sources.snapshot_files import key_records, measure_keys

    keys = [f"cardmarket/catalogue/onepiece/2026/08/2026-08-{d:02}.json" for d in range(1, 29)]
    for key in keys:
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_text('{"products": [{"idProduct": 1}]}')
    named = spark.createDataFrame([(k,) for k in keys], "key string")
    for read in (measure_keys(named, str(tmp_path)), key_records(named, str(tmp_path))):
        tasks = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sorted(r["count"] for r in tasks) == [7, 7, 7, 7]


def test_envelope_around_an_objects_lines(spark, tmp_path):
    lines = spark.createDataFrame([(k, p, f'"{p}é"') for k in ("a.json", "b.json.gz") for p in (3, 1, 2)], "key string, pos int, text string")
    written = write_objects(lines, str(tmp_path), lambda key: (f'{{"of": "{key}", "data": [', "]}"))
    assert {r["status"] for r in written.collect()} == {"created"}
    text = (tmp_path / "a.json").read_text()
    assert text == '{"of": "a.json", "data": [\n"1é"\n,"2é"\n,"3é"\n]}\n'
    assert gzip.decompress((tmp_path / "b.json.gz").read_bytes()).decode() == text.replace("a.json", "b.json.gz")
