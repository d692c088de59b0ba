"""Daily archive manifests and the calendar derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from pricetide.schemas import MANIFEST


def _json(reader: DataFrameReader | DataStreamReader) -> DataFrameReader | DataStreamReader:
    return reader.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All manifests, malformed files included (flagged in `malformed`).

    `path_date` is the day named by the file, which a valid manifest repeats in
    `run_date`.
    """
    return _dated(_json(spark.read).json(paths, multiLine=True))


def stream_manifests(spark: SparkSession, path: str, per_batch: int) -> DataFrame:
    """The same as a stream that takes `per_batch` new manifests at a time, in order of time."""
    reader = _json(spark.readStream).option("maxFilesPerTrigger", str(per_batch))
    return _dated(reader.json(path, multiLine=True))


def _dated(manifests: DataFrame) -> DataFrame:
    return (
        manifests.select(
            F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})\.json", 1)
            .try_cast("date")
            .alias("path_date"),
            "run_date",
            F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
            "files",
            (F.col("_corrupt").isNotNull() | F.col("run_date").isNull() | F.col("files").isNull()).alias(
                "malformed"
            ),
        )
    )


def manifest_files(manifests: DataFrame) -> DataFrame:
    """One row per file entry of the well-formed manifests."""
    return (
        manifests.filter(~F.col("malformed"))
        .select("path_date", "run_date", "schema_version", F.explode("files").alias("f"))
        .select(
            "path_date",
            "run_date",
            "schema_version",
            F.col("f.game").alias("game_key"),
            F.col("f.kind").alias("kind"),
            F.col("f.key").alias("key"),
            F.col("f.sha256_uncompressed").alias("sha256"),
            F.col("f.size_uncompressed").alias("size"),
            F.col("f.fetched_at").alias("fetched_at"),
            F.col("f.headers").alias("headers"),
            F.col("f.source_created_at").alias("source_created_at"),
            F.coalesce("f.unchanged_from_previous", F.lit(False)).alias("unchanged"),
        )
    )


def latest_pointer(manifests: DataFrame) -> DataFrame:
    """The small pointer document of each manifest: date and (game, kind, sha, key) entries."""
    return manifests.filter(~F.col("malformed")).select(
        F.col("run_date").alias("date"),
        F.transform(
            "files",
            lambda f: F.struct(
                f["game"].alias("game"),
                f["kind"].alias("kind"),
                f["sha256_uncompressed"].alias("sha256_uncompressed"),
                f["key"].alias("key"),
            ),
        ).alias("files"),
    )


def archive_calendar(files: DataFrame, prices: DataFrame, run_date: object | None = None) -> DataFrame:
    """Observation days per game: (game_key, value_date, unchanged).

    A day counts when its manifest lists a price guide for the game. Games without
    any such manifest fall back to the days found in their prices. A gap stays a
    gap: no day is filled in.
    """
    day = F.col("run_date").try_cast("date")
    listed = (
        files.filter(F.col("kind") == "priceguide")
        .select("game_key", day.alias("value_date"), "unchanged")
        .filter(F.col("value_date").isNotNull())
    )
    observed = prices.select("game_key", "value_date")
    if run_date is not None:
        listed = listed.filter(F.col("value_date") <= F.lit(run_date))
        observed = observed.filter(F.col("value_date") <= F.lit(run_date))
    from_manifests = listed.groupBy("game_key", "value_date").agg(
        F.bool_or("unchanged").alias("unchanged")
    )
    fallback = (
        observed.distinct()
        .join(from_manifests.select("game_key").distinct(), "game_key", "left_anti")
        .withColumn("unchanged", F.lit(False))
    )
    return from_manifests.unionByName(fallback)
