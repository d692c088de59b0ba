"""Stable identifiers and archive key formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the marketplace namespace that prefixes every stable id and snapshot key.
NAMESPACE = "cardmarket"


def product_id(game: Column, cm_product_id: Column) -> Column:
    return F.concat(
        F.lit(f"{NAMESPACE}:"), game, F.lit(":product:"), cm_product_id.cast("string")
    )


def variant_id(game: Column, cm_product_id: Column, variant: Column) -> Column:
    return F.concat(product_id(game, cm_product_id), F.lit(":"), variant)


def set_id(game: Column, cm_expansion_id: Column) -> Column:
    return F.concat(
        F.lit(f"{NAMESPACE}:"), game, F.lit(":expansion:"), cm_expansion_id.cast("string")
    )


def snapshot_key(kind: Column, game: Column, run_date: Column) -> Column:
    """Archive key of one source snapshot."""
    return F.concat(
        F.lit(f"{NAMESPACE}/"),
        kind,
        F.lit("/"),
        game,
        F.lit("/"),
        F.date_format(run_date, "yyyy/MM"),
        F.lit("/"),
        run_date.cast("string"),
        F.lit(".json.gz"),
    )


def manifest_key(run_date: Column) -> Column:
    return F.concat(F.lit("manifests/"), run_date.cast("string"), F.lit(".json"))


def conflict_key(key: Column, n: Column) -> Column:
    """Key under which a conflicting candidate is preserved."""
    return F.concat(
        F.regexp_replace(key, r"\.json\.gz$", ""),
        F.lit(".conflict-"),
        n.cast("string"),
        F.lit(".json.gz"),
    )


def object_category(key: Column) -> Column:
    """Storage category by key prefix."""
    return (
        F.when(key.startswith(f"{NAMESPACE}/"), "raw_snapshots")
        .when(key.startswith("manifests/"), "archive_manifests")
        .when(
            key.startswith("derived/catalogue/") | key.startswith("derived/prices/"),
            "normalized_data",
        )
        .when(key.startswith("derived/indexes/"), "shadow_indexes")
        .when(key.startswith("derived/"), "pipeline_receipts")
        .otherwise("other")
    )
