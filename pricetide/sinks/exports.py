"""JSON and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.performance import history_csv_rows

CSV_COLUMNS = [
    "value_date",
    "index_value",
    "daily_return",
    "n_constituents_active",
    "n_capped",
    "n_carried_forward",
    "calc_version",
]


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines with columns in name order and explicit nulls, rows in order of all columns.

    The range covers the whole row after the partition columns, so that the rows of one
    partition value are spread over many tasks, and a rerun writes them in the same order.
    """
    parts = partition_by or []
    rest = sorted(c for c in df.columns if c not in parts)
    sortable = [f.name for f in df.schema.fields if f.name in rest and f.dataType.typeName() != "map"]
    ordered = df.select(*parts, *rest)
    if parts or sortable:
        ordered = ordered.repartitionByRange(*parts, *sortable).sortWithinPartitions(*parts, *sortable)
    writer = ordered.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*parts) if parts else writer).json(path)


def write_history_csv(history: DataFrame, definitions: DataFrame, path: str) -> None:
    """Public history as CSV, one folder per published index."""
    rows = history_csv_rows(history, definitions)
    (
        rows.repartitionByRange("index_code", "value_date")
        .sortWithinPartitions("index_code", "value_date")
        .select("index_code", *CSV_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("emptyValue", "")
        .partitionBy("index_code")
        .csv(path)
    )


def visible_rows(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows of published indexes only; the other indexes export nothing."""
    shown = definitions.filter(
        (F.col("status") == "published") & (F.col("history_start_kind") == "published")
    ).select("index_code")
    return rows.join(shown, "index_code", "left_semi")


def write_public_export(
    definitions: DataFrame,
    summaries: DataFrame,
    history: DataFrame,
    intervals: DataFrame,
    rebalances: DataFrame,
    search: DataFrame,
    root: str,
) -> None:
    """Summary, history, constituents, rebalances and search tables of the public site."""
    write_json(summaries, f"{root}/summary", ["index_code"])
    write_json(visible_rows(history, definitions), f"{root}/history", ["index_code"])
    write_json(visible_rows(intervals, definitions), f"{root}/constituents", ["index_code"])
    write_json(visible_rows(rebalances, definitions), f"{root}/rebalances", ["index_code"])
    write_json(search, f"{root}/search")
