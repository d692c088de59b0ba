"""Exact ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import cut_lineage, fits_broadcast

_BROADCAST_ROWS = 200_000


def rank_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its group under a total order.

    One group may hold a third of all rows, so no group is gathered in one task:
    rows are range-partitioned by (group, order), sorted inside each partition and
    numbered there; the number of rows a group has in earlier partitions is then
    added. The numbered rows are checkpointed first, because a recomputed range
    partitioning may cut elsewhere.
    """
    group_cols = [F.col(g) for g in groups]
    placed = (
        df.repartitionByRange(*group_cols, *order)
        .sortWithinPartitions(*group_cols, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    # One row per (partition, group): at most partitions + groups rows.
    pieces = placed.groupBy("_pid", *groups).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "_pid", *groups, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    if fits_broadcast(pieces, _BROADCAST_ROWS):
        pieces = F.broadcast(pieces)
    ranked = placed.join(pieces, ["_pid", *groups])
    return ranked.withColumn(
        name, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("int")
    ).drop("_pid", "_pos", "_first", "_before")
