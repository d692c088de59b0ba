"""Parquet outputs with content receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricetide.functions.hashing import table_fingerprint
from pricetide.schemas import RECEIPT
from pricetide.sinks.versions import Receipt, VersionedTable, open_table


def measure(df: DataFrame) -> tuple[int, str]:
    """Row count and order-free fingerprint of a frame."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), table_fingerprint(df).alias("fp")).first()
    return int(row["rows"]), str(row["fp"])


def write_sorted(
    df: DataFrame,
    path: str,
    schema: StructType,
    sort_by: list[str],
    partition_by: list[str] | None = None,
    dynamic: bool = False,
) -> None:
    """zstd Parquet with a fixed column set, range-partitioned and sorted.

    Range partitioning on the sort columns splits a hot partition value over many
    files and keeps min/max statistics tight. With `dynamic`, only the partitions
    present in `df` are replaced. An empty frame still writes its schema.
    """
    fixed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    order = [*(partition_by or []), *[c for c in sort_by if c not in (partition_by or [])]]
    writer = (
        fixed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("compression", "zstd")
    )
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The newest version of a stored table, or None when it does not exist."""
    table = open_table(spark, path, schema)
    return None if table is None else table.read()


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a stored table; an error when it does not exist."""
    found = stored(spark, path)
    if found is None:
        raise RuntimeError(f"missing table {path}")
    return found


def write_if_changed(
    df: DataFrame,
    path: str,
    schema: StructType,
    sort_by: list[str],
    partition_by: list[str] | None = None,
) -> Receipt:
    """Make `df` the content of a versioned table, as a new version only where it differs.

    Content means rows, not bytes: Parquet files of equal rows need not be equal. The frame is
    written beside the versions that readers see, and may read the one it replaces.
    """
    return VersionedTable(df.sparkSession, path, schema, partition_by, sort_by).replace(df)


def receipts_frame(spark: SparkSession, receipts: list[Receipt]) -> DataFrame:
    return spark.createDataFrame(
        [(r.output, r.rows, r.fingerprint, r.changed) for r in receipts], RECEIPT
    )


def dataset_manifest(receipts: DataFrame, version: str) -> DataFrame:
    """Manifest table: the checksum of every output under one dataset version."""
    keep = [c for c in ("rows", "bytes") if c in receipts.columns]
    return receipts.select(F.lit(version).alias("dataset_version"), "output", "fingerprint", *keep)


def _by_month(rows: DataFrame) -> DataFrame:
    """`rows` with the month that dated receipts are stored by; undated ones have one."""
    dated = "run_date" in rows.columns
    return rows.withColumn("month", F.date_format("run_date", "yyyy-MM") if dated else F.lit("all"))


def _months(rows: DataFrame) -> list[dict[str, str]]:
    """The months of a batch of receipts: a calendar's worth at most."""
    return [{"month": r["month"]} for r in rows.select("month").distinct().collect()]


def _receipts_table(rows: DataFrame, path: str) -> VersionedTable:
    shape = StructType([*rows.schema.fields, StructField("month", StringType())])
    return VersionedTable(rows.sparkSession, path, shape, ["month"], [])


def append_receipts(
    spark: SparkSession, path: str, run_notes: DataFrame, keys: list[str]
) -> DataFrame:
    """Receipts table after a run: notes of the same key are replaced, others kept.

    Only the months of the notes are read and written anew.
    """
    from pricetide.operators.merge import upsert

    table, notes = _receipts_table(run_notes, path), _by_month(run_notes)
    touched = _months(notes)
    held = table.read_partitions(touched)
    table.replace_partitions(notes if held is None else upsert(held, notes, keys))
    return table.read().drop("month")


def replace_groups(spark: SparkSession, path: str, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Table after a run: all rows of `groups` go, `rows` come, other groups stay.

    A group without any new row is left without rows. Only the months of the groups are read
    and written anew.
    """
    table, new = _receipts_table(rows, path), _by_month(rows)
    touched = _months(_by_month(groups))
    held = table.read_partitions(touched)
    kept = new if held is None else held.join(groups, groups.columns, "left_anti").unionByName(new)
    table.replace_partitions(kept, emptied=touched)
    return table.read().drop("month")
