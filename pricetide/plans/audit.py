"""Archive audit: coverage, integrity sample, storage, readiness and projections."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.ids import NAMESPACE
from pricetide.operators import archive, gates
from pricetide.session import cut_lineage
from pricetide.sources.snapshot_files import measure_keys


@dataclass(frozen=True)
class AuditReport:
    errors: DataFrame
    coverage: DataFrame
    storage: DataFrame
    categories: DataFrame
    largest: DataFrame
    sampled: DataFrame
    measured: DataFrame
    readiness: DataFrame
    projections: DataFrame
    summary: DataFrame
    warnings: DataFrame


def audit_archive(
    spark: SparkSession,
    manifests: DataFrame,
    files: DataFrame,
    documents: DataFrame | str,
    objects: DataFrame,
    definitions: DataFrame,
    quality: DataFrame,
    inceptions: DataFrame,
    start: date,
    end: date,
    sample_rate: float,
    seed: str,
    required_lookback_days: int = 60,
    min_records: int = archive.MIN_PRICEGUIDE_RECORDS,
) -> AuditReport:
    """Audit the manifests of [start, end].

    `manifests`/`files` come from `sources.manifests`. `documents` is the archive's folder, of
    which only the sampled keys' files are opened, or a table of landed bodies (key, body), of
    which only the sampled keys' rows are used. Errors and the sample's measures are stored, as
    several parts of the report are made from them.
    """
    if required_lookback_days < 1:
        raise ValueError("required_lookback_days must be positive")
    days = archive.calendar_days(spark.range(1), F.lit(start), F.lit(end))
    in_range = manifests.filter(F.col("path_date").between(F.lit(start), F.lit(end)))
    entries = files.filter(F.col("path_date").between(F.lit(start), F.lit(end))).withColumn(
        "run_date", F.col("run_date").try_cast("date")
    )
    sampled = cut_lineage(archive.sample_files(entries, sample_rate, seed))
    chosen = entries.join(sampled, "key", "left_semi")
    if isinstance(documents, str):
        measured = archive.measured_files(measure_keys(sampled, documents))
    else:
        measured = archive.measure_bodies(archive.sampled_bodies(documents, sampled, seed))
    measured = cut_lineage(measured)
    content = archive.compare_content(chosen, measured, min_records)
    errors = cut_lineage(archive.audit_errors(days, in_range, entries, inceptions, content))
    cover = archive.coverage(
        days, in_range.filter(~F.col("malformed")).select(F.col("path_date").alias("run_date"))
    )
    days_present = in_range.filter(~F.col("malformed")).agg(F.count_distinct("path_date")).scalar()
    storage = archive.storage_totals(objects)
    readiness = gates.audit_readiness(
        definitions, quality, F.lit(end), days_present, required_lookback_days
    )
    return AuditReport(
        errors=errors,
        coverage=cover,
        storage=storage,
        categories=archive.storage_by_category(objects),
        largest=archive.largest_objects(objects),
        sampled=sampled,
        measured=measured,
        readiness=readiness,
        projections=archive.projected_dates(inceptions, required_lookback_days),
        summary=_summary(errors, entries, sampled, objects, readiness),
        warnings=_warnings(storage),
    )


def _summary(
    errors: DataFrame, entries: DataFrame, sampled: DataFrame, objects: DataFrame, readiness: DataFrame
) -> DataFrame:
    """One row of totals: status, files listed and verified, snapshot objects, cutover state.

    A cutover may be reviewed when there is no error and every index is eligible.
    """
    found = errors.agg(F.count(F.lit(1)).alias("error_count"))
    files = entries.agg(F.count_distinct("key").alias("file_count"))
    verified = sampled.agg(F.count(F.lit(1)).alias("verified_file_count"))
    snapshots = objects.agg(
        F.count_if(F.col("key").startswith(f"{NAMESPACE}/")).alias("snapshot_object_count")
    )
    ready = readiness.agg(F.coalesce(F.bool_and(F.col("state") == gates.ELIGIBLE), F.lit(True)).alias("_ready"))
    # Each side is one row.
    row = found
    for side in (files, verified, snapshots, ready):
        row = row.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one").drop("_one")
    clean = F.col("error_count") == 0
    return row.select(
        F.when(clean, "pass").otherwise("fail").alias("status"),
        "error_count",
        "file_count",
        "verified_file_count",
        "snapshot_object_count",
        F.when(clean & F.col("_ready"), gates.ELIGIBLE).otherwise("accumulating").alias("cutover_state"),
    )


def _warnings(storage: DataFrame) -> DataFrame:
    """A row for each budget that is not within its free part."""
    return storage.filter(F.col("status") != "within_free_tier").select(
        F.concat(F.lit("storage status is "), "status").alias("warning")
    )
