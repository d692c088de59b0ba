"""Stored liquidity summaries: only months whose prices changed are read again."""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import liquidity
from pricetide.schemas import LIQUIDITY_SUMMARY
from pricetide.sinks.versions import Part, VersionedTable


def _source(part: Part, lookback_days: int, floors: list[str]) -> str:
    """Names what a month's summaries were made from: its rows, the look-back and the price floors."""
    text = f"{part.rows}|{part.hash}|{lookback_days}|{','.join(floors)}"
    return "s" + hashlib.sha256(text.encode()).hexdigest()[:16]


def refresh_summaries(
    spark: SparkSession, path: str, prices: VersionedTable, definitions: DataFrame, lookback_days: int
) -> VersionedTable:
    """Bring the summaries below `path` up to the newest version of a price table.

    `prices` is partitioned by game_key and month. A partition of the summaries names in its
    folder the count and hash of the price rows it was made from, so which months are new,
    changed or gone follows from the two version files; other months aren't read. One switch
    replaces all of them.
    """
    table = VersionedTable(
        spark, path, LIQUIDITY_SUMMARY, ["game_key", "month", "source"], ["stable_variant_id", "segment", "min_price"]
    )
    # Definitions are a parameter table (tens of rows).
    floors: dict[str, set[str]] = {}
    for r in definitions.select("game_key", "product_kind", "min_price").distinct().collect():
        floors.setdefault(r["game_key"], set()).add(f"{r['product_kind']}:{r['min_price']!r}")
    wanted = set()
    for part in prices.parts() or []:
        values = prices.values(part)
        game = values["game_key"]
        if part.rows and game in floors:
            wanted.add((game, values["month"], _source(part, lookback_days, sorted(floors[game]))))
    held = {tuple(table.values(p).values()) for p in table.parts() or [] if p.rows}
    fresh = sorted(wanted - held)
    stale = [dict(zip(table.partition_by, values, strict=True)) for values in sorted(held - wanted)]
    if not fresh and not stale and table.versions():
        return table
    names = spark.createDataFrame(fresh, "game_key string, month string, source string")
    rows = prices.read_partitions([{"game_key": g, "month": m} for g, m, _ in fresh])
    if rows is None:
        rows = spark.createDataFrame([], prices.schema)
    made = liquidity.segment_summaries(rows, definitions, lookback_days)
    made = made.withColumn("month", F.date_format("segment", "yyyy-MM")).join(names, ["game_key", "month"])
    table.replace_partitions(made, emptied=stale)
    return table


def stored_scores(
    table: VersionedTable, definitions: DataFrame, lookback_days: int, since: date | None = None
) -> DataFrame:
    """Scores at month starts, from stored summaries; those from `since` on read only their windows' months."""
    if since is None:
        summaries = table.read()
    else:
        first = f"{since - timedelta(days=lookback_days):%Y-%m}"
        summaries = table.read(keep=lambda values: values["month"] >= first)
    if summaries is None:
        summaries = table.spark.createDataFrame([], table.schema)
    scores = liquidity.score_summaries(summaries, definitions, lookback_days)
    return scores if since is None else scores.filter(F.col("effective_date") >= F.lit(since))
