from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetide.schemas import struct
from pricetide.sinks.versions import VersionConflict, VersionedTable, fingerprint_of, open_table, upsert_keys
from tests.conftest import rows

SHAPE = struct("day string, k bigint, v string")


def frame(spark, data):
    return spark.createDataFrame(data, SHAPE)


def make(spark, path, **kwargs):
    return VersionedTable(spark, str(path), SHAPE, **({"partition_by": ["day"], "sort_by": ["k"]} | kwargs))


def test_partitions_and_fingerprints_add_up(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    assert table.read() is None and table.fingerprint() is None and open_table(spark, table.root) is None
    first = table.replace(frame(spark, [("a b", 1, "x"), ("a b", 2, None), ("c=d/é", 3, "z")]))
    assert first.changed and first.rows == 3
    assert rows(table.read(), "day", "k", "v") == [("a b", 1, "x"), ("a b", 2, None), ("c=d/é", 3, "z")]
    kept = {p.place: p.folder for p in table.parts()}
    second = table.replace_partitions(frame(spark, [("c=d/é", 3, "new"), ("e", 4, "w")]))
    assert second.changed and second.rows == 4
    # The untouched partition keeps its files.
    assert {p.place: p.folder for p in table.parts()}["day=a b/"] == kept["day=a b/"]
    whole = make(spark, tmp_path / "u").replace(table.read())
    assert whole.fingerprint == second.fingerprint == fingerprint_of(table.parts())
    assert rows(table.read(1), "k", "v") == [(1, "x"), (2, None), (3, "z")]
    assert rows(table.read_partitions([{"day": "c=d/é"}, {"day": "none"}]), "v") == [("new",)]
    assert rows(table.manifest(), "rows") == [(1,), (1,), (2,)]
    again = open_table(spark, table.root)
    assert (again.schema, again.partition_by, again.sort_by) == (SHAPE, ["day"], ["k"])
    # Rows that trade their partitions are another content.
    traded = make(spark, tmp_path / "v").replace(table.read().withColumn("day", F.translate("day", "ae", "ea")))
    assert traded.fingerprint != whole.fingerprint
    table.replace_partitions(frame(spark, []), emptied=[{"day": "e"}])
    assert rows(table.read(), "k") == [(1,), (2,), (3,)]


def test_same_content_makes_no_version(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    data = frame(spark, [("a", 1, "x"), ("b", 2, "y")])
    table.replace(data)
    again = table.replace(data.repartition(3))
    assert not again.changed and table.versions() == [1]
    assert len(list((tmp_path / "t" / "data").rglob("batch=*"))) == 2
    # A value that moves to another column is a change.
    assert table.replace(frame(spark, [("a", 1, "y"), ("b", 2, "x")])).changed


def test_a_run_that_dies_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path / "t")
    table.replace(frame(spark, [("a", 1, "x")]))

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "_commit", dies)
    with pytest.raises(RuntimeError, match="lost"):
        table.replace_partitions(table.read().withColumn("v", F.lit("half")))
    monkeypatch.undo()
    assert rows(table.read(), "k", "v") == [(1, "x")]
    assert table.clean() == 1 and rows(table.read(), "k", "v") == [(1, "x")]
    table.replace_partitions(table.read().withColumn("v", F.lit("whole")))
    assert rows(table.read(), "k", "v") == [(1, "whole")]


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    one, two = make(spark, tmp_path / "t"), make(spark, tmp_path / "t")
    one.replace(frame(spark, [("a", 1, "x")]))
    written = VersionedTable._write_batch

    def meanwhile(self, data, batch):
        monkeypatch.undo()
        two.replace(frame(spark, [("a", 1, "two")]))
        return written(self, data, batch)

    monkeypatch.setattr(VersionedTable, "_write_batch", meanwhile)
    with pytest.raises(VersionConflict):
        one.replace(frame(spark, [("a", 1, "one")]))
    assert rows(one.read(), "v") == [("two",)]


def test_old_versions_expire_with_their_files(spark, tmp_path):
    table = make(spark, tmp_path / "t", partition_by=[])
    for i in range(5):
        table.replace(frame(spark, [("a", i, "x")]))
    assert table.versions() == [3, 4, 5]
    assert len(list((tmp_path / "t" / "data").glob("batch=*"))) == 3
    assert rows(table.read(3), "k") == [(2,)]
    empty = table.replace(frame(spark, []))
    assert empty.changed and empty.rows == 0 and table.read().count() == 0
    assert not table.replace(frame(spark, [])).changed


def test_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    shape = struct("k bigint, v string, bucket int")
    table = VersionedTable(spark, str(tmp_path / "t"), shape, ["bucket"], ["k"])
    upsert_keys(table, spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"], 16)
    before = {p.folder for p in table.parts()}
    changes = spark.createDataFrame([(7, "new"), (7, "nay"), (1000, "added")], "k long, v string")
    upsert_keys(table, changes, ["k"], 16)
    assert len(before - {p.folder for p in table.parts()}) <= 2
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {**dict.fromkeys(range(200), "old"), 7: "new", 1000: "added"}
