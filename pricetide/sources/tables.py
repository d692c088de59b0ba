"""Normalised tables, static JSON tables and object listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from pricetide.schemas import PRICE_TABLE, PRICES
from pricetide.sinks.versions import open_table


def read_prices(spark: SparkSession, root: str, run_date: date) -> DataFrame:
    """Price history up to a day from the (game_key, month) partitioned table.

    Folders of later months aren't listed; the day predicate reaches the scan. The
    schema is given, so files that lack a column read as NULL there and no footers
    are merged.
    """
    month = run_date.strftime("%Y-%m")
    table = open_table(spark, root, PRICE_TABLE)
    if table is None:
        raise RuntimeError(f"missing price table {root}")
    held = table.read(keep=lambda values: values["month"] <= month)
    return held.filter(F.col("value_date") <= F.lit(run_date)).select(*PRICES.names)


def read_catalogue(
    spark: SparkSession, path: str, schema: StructType, required: bool = False
) -> DataFrame:
    """A catalogue table; when it does not exist yet, empty or (if required) an error.

    Both versioned tables and plain Parquet folders are read.
    """
    table = open_table(spark, path, schema)
    if table is not None:
        return table.read()
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
            raise
        if required:
            raise RuntimeError(f"missing normalised catalogue {path}") from exc
        return spark.createDataFrame([], schema)


def read_static_json(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """Per-index JSON files (…/<index_code>/<file>.json) as one table keyed by index_code."""
    return (
        spark.read.schema(schema)
        .json(paths, multiLine=True)
        .withColumn("index_code", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+\.json$", 1))
    )


def visible(definitions: DataFrame) -> DataFrame:
    """Definitions readers may see."""
    return definitions.filter(F.col("status").isin("published", "accumulating"))


def visible_children(children: DataFrame, definitions: DataFrame, *keys: str) -> DataFrame:
    """Rows whose parent definition is visible (EXISTS as a semi join)."""
    return children.join(visible(definitions).select(*keys), list(keys), "left_semi")
