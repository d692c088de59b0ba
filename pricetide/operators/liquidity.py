"""Liquidity scoring of every variant over the look-back window of every rebalance date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import month_start, month_starts_seen_from
from pricetide.functions.prices import clip, inverse_dispersion, used_price

IDENTITY = ["game_key", "product_kind", "stable_variant_id", "cm_product_id", "variant_key"]


def observation_days(prices: DataFrame) -> DataFrame:
    """Per-day scoring inputs of each variant.

    `previous_avg`/`previous_date` are the variant's previous row; one lag serves
    all look-back windows because a window only accepts it when that row lies
    inside. One shuffle by variant; a variant has one row per calendar day.
    """
    by_variant = Window.partitionBy(*IDENTITY).orderBy("value_date")
    avg, low = F.col("price_avg").cast("double"), F.col("price_low").cast("double")
    return prices.select(
        *IDENTITY,
        "value_date",
        avg.alias("price_avg"),
        low.alias("price_low"),
        F.col("avg30").cast("double").alias("avg30"),
        used_price(avg, low).alias("used"),
        inverse_dispersion(low, avg).alias("dispersion_day"),
        F.lag(avg).over(by_variant).alias("previous_avg"),
        F.lag("value_date").over(by_variant).alias("previous_date"),
    )


def effective_dates_for(day: Column, lookback: int, effective_dates: list[date] | None) -> Column:
    """Rebalance dates whose half-open look-back window holds `day`: all month
    starts, or those of an explicit list."""
    if effective_dates is None:
        return month_starts_seen_from(day, lookback)
    dates = F.array(*[F.lit(d) for d in sorted(set(effective_dates))])
    return F.filter(dates, lambda e: (e > day) & (e <= F.date_add(day, lookback)))


def score_liquidity(
    prices: DataFrame,
    definitions: DataFrame,
    lookback_days: int,
    effective_dates: list[date] | None = None,
) -> DataFrame:
    """Scores per (index, effective date, variant).

    Each row reaches at most ceil(L/28)+1 monthly windows. The rows are expanded
    after the shuffle by variant and the aggregation groups by a superset of that
    key, so the price rows are shuffled once.
    """
    days = observation_days(prices)
    eff = effective_dates_for(F.col("value_date"), lookback_days, effective_dates)
    in_window = F.col("previous_date") >= F.date_sub(F.col("effective_date"), lookback_days)
    # Definitions are a parameter table (tens of rows).
    rules = (
        definitions.select("index_code", "game_key", "product_kind", "min_price", "base_date")
    )
    expanded = (
        days.withColumn("effective_date", F.explode(eff))
        .join(rules, ["game_key", "product_kind"])
        .filter(F.col("effective_date") >= F.col("base_date"))
    )
    changed = (
        in_window
        & F.col("price_avg").isNotNull()
        & F.col("previous_avg").isNotNull()
        & (F.col("price_avg") != F.col("previous_avg"))
    )
    sums = expanded.groupBy(*IDENTITY, "index_code", "effective_date").agg(
        F.count_if(F.col("price_avg") > 0).alias("primary_observation_days"),
        F.count_if(F.col("used") >= F.col("min_price")).alias("price_floor_days"),
        F.count_if(F.col("used") <= 0).alias("suspect_zero_days"),
        F.count_if(changed).alias("price_update_days"),
        F.avg("dispersion_day").alias("inverse_dispersion"),
        F.count("used").alias("history_days"),
        F.min("value_date").alias("first_observation_date"),
        F.max("value_date").alias("last_observation_date"),
        F.max_by("avg30", F.when(F.col("avg30").isNotNull(), F.col("value_date"))).alias("source_avg30"),
        F.avg("used").alias("mean_used_price"),
    )
    return with_ratios(sums, lookback_days)


def with_ratios(sums: DataFrame, expected_days: int) -> DataFrame:
    """Ratios against the full calendar window and the clipped liquidity score."""
    days = float(expected_days)
    out = (
        sums.withColumn("observation_ratio", F.col("primary_observation_days") / days)
        .withColumn("price_floor_ratio", F.col("price_floor_days") / days)
        .withColumn("suspect_zero_ratio", F.col("suspect_zero_days") / days)
        .withColumn("price_update_frequency", F.col("price_update_days") / float(max(expected_days - 1, 1)))
        .withColumn("avg30", F.coalesce("source_avg30", "mean_used_price"))
    )
    score = (
        0.5 * F.col("observation_ratio")
        + 0.3 * F.col("price_update_frequency")
        + 0.2 * F.col("inverse_dispersion")
    )
    return out.withColumn("liquidity_score", clip(score, 0.0, 1.0))


def segment_start(day: Column, lookback: int) -> Column:
    """The first day of the segment that holds `day`.

    The calendar is cut at month starts and `lookback` days before them, so every look-back
    window that ends at a month start is a run of whole segments, and a segment lies in one month.
    """
    window_start = F.date_sub(month_start(F.date_add(day, lookback)), lookback)
    return F.greatest(month_start(day), window_start)


def segment_summaries(prices: DataFrame, definitions: DataFrame, lookback_days: int) -> DataFrame:
    """What scoring needs of each variant's rows in a segment, for each price floor in use.

    Sums and counts add up over segments. Price changes are counted inside the segment; the
    first and last average are kept, so that the change at a border is found by comparing
    neighbours. A segment holds a month's rows of a variant at most, and a summary depends on
    no row outside of it.
    """
    floors = definitions.select("game_key", "product_kind", "min_price").distinct()
    avg, low = F.col("price_avg").cast("double"), F.col("price_low").cast("double")
    in_segment = Window.partitionBy(*IDENTITY, "segment").orderBy("value_date")
    days = prices.withColumn("segment", segment_start(F.col("value_date"), lookback_days)).select(
        *IDENTITY,
        "segment",
        "value_date",
        avg.alias("price_avg"),
        F.col("avg30").cast("double").alias("avg30"),
        used_price(avg, low).alias("used"),
        inverse_dispersion(low, avg).alias("dispersion_day"),
        F.lag(avg).over(in_segment).alias("previous_avg"),
    )
    priced = F.when(F.col("avg30").isNotNull(), F.col("value_date"))
    return (
        days.join(floors, ["game_key", "product_kind"])
        .groupBy(*IDENTITY, "segment", "min_price")
        .agg(
            F.count_if(F.col("price_avg") > 0).alias("primary_days"),
            F.count_if(F.col("used") >= F.col("min_price")).alias("floor_days"),
            F.count_if(F.col("used") <= 0).alias("zero_days"),
            F.count_if(F.col("price_avg") != F.col("previous_avg")).alias("changes"),
            F.sum("dispersion_day").alias("dispersion_sum"),
            F.count("dispersion_day").alias("dispersion_days"),
            F.sum("used").alias("used_sum"),
            F.count("used").alias("used_days"),
            F.min("value_date").alias("first_date"),
            F.max("value_date").alias("last_date"),
            F.min_by("price_avg", "value_date").alias("first_avg"),
            F.max_by("price_avg", "value_date").alias("last_avg"),
            F.max_by("avg30", priced).alias("avg30"),
            F.max(priced).alias("avg30_date"),
        )
    )


def score_summaries(summaries: DataFrame, definitions: DataFrame, lookback_days: int) -> DataFrame:
    """The scores of `score_liquidity` at all month starts, from summaries alone.

    `summaries` must be made with the same look-back. One shuffle of summaries by variant; a
    window combines at most 2 * (ceil(L/28) + 1) of them.
    """
    by_variant = Window.partitionBy(*IDENTITY, "min_price").orderBy("segment")
    rules = definitions.select("index_code", "game_key", "product_kind", "min_price", "base_date")
    expanded = (
        summaries.withColumn("previous_avg", F.lag("last_avg").over(by_variant))
        .withColumn("previous_segment", F.lag("segment").over(by_variant))
        .withColumn("effective_date", F.explode(month_starts_seen_from(F.col("segment"), lookback_days)))
        .join(rules, ["game_key", "product_kind", "min_price"])
        .filter(F.col("effective_date") >= F.col("base_date"))
    )
    at_border = (F.col("previous_segment") >= F.date_sub(F.col("effective_date"), lookback_days)) & (
        F.col("first_avg") != F.col("previous_avg")
    )
    sums = expanded.groupBy(*IDENTITY, "index_code", "effective_date").agg(
        F.sum("primary_days").alias("primary_observation_days"),
        F.sum("floor_days").alias("price_floor_days"),
        F.sum("zero_days").alias("suspect_zero_days"),
        (F.sum("changes") + F.count_if(at_border)).alias("price_update_days"),
        F.try_divide(F.sum("dispersion_sum"), F.sum("dispersion_days")).alias("inverse_dispersion"),
        F.sum("used_days").alias("history_days"),
        F.min("first_date").alias("first_observation_date"),
        F.max("last_date").alias("last_observation_date"),
        F.max_by("avg30", "avg30_date").alias("source_avg30"),
        F.try_divide(F.sum("used_sum"), F.sum("used_days")).alias("mean_used_price"),
    )
    return with_ratios(sums, lookback_days)
