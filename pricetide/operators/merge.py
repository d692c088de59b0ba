"""Keyed merges: catalogue merge, last-wins dedupe, upsert, replace and append-only checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `order` values.

    An aggregate rather than a row_number window, so duplicates of a hot key are
    reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_last"))
        .select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in df.columns])
    )


def merge_catalogue(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Full outer merge: the current row replaces every attribute (with NULL too),
    first_seen takes the minimum, last_seen the maximum, absent rows stay."""
    old, new = existing.alias("old"), current.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_new = F.col(f"new.{key}").isNotNull()
    out: list[Column] = []
    for c in current.columns:
        if c == key:
            value = F.coalesce(f"new.{c}", f"old.{c}")
        elif c == "first_seen":
            value = F.least(f"old.{c}", f"new.{c}")
        elif c == "last_seen":
            value = F.greatest(f"old.{c}", f"new.{c}")
        else:
            value = F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def widen_union(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is NULL, numeric types widen."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


PRICE_KEY = ["game_key", "cm_product_id", "variant_key", "value_date"]


def merge_prices(existing: DataFrame, current: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Price rows after a (re)played batch: one per product, variant and day, current wins.

    With `order` (the key's columns and others that follow from them) rows come dealt by range and
    sorted by it: the shuffle that puts a key's rows together is the one that a sorted table needs.
    """
    both = widen_union(
        existing.withColumn("_batch", F.lit(0)), current.withColumn("_batch", F.lit(1))
    )
    if order is None:
        return keep_last(both, PRICE_KEY, ["_batch"]).drop("_batch")
    dealt = both.repartitionByRange(*order)
    return keep_last(dealt, order, ["_batch"]).drop("_batch").sortWithinPartitions(*order)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace all columns by key; the incoming keys are unique."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def replace_keys(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Delete every row of the incoming keys, then insert (a key may hold many rows)."""
    touched = incoming.select(*keys).distinct()
    return existing.join(touched, keys, "left_anti").unionByName(incoming)


def append_only_violations(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Published rows that a new version dropped or changed."""
    rest = sorted(c for c in old.columns if c not in keys)

    def digest(side: DataFrame, name: str) -> DataFrame:
        return side.select(*keys, F.xxhash64(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias(name))

    joined = digest(old, "h_old").join(
        digest(new, "h_new"), keys, "left"
    )
    return joined.filter(~F.col("h_old").eqNullSafe(F.col("h_new"))).select(
        *keys, F.when(F.col("h_new").isNull(), "deleted").otherwise("updated").alias("violation")
    )
