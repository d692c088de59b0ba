"""Chain-linked equal-weight index values from a member panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.prices import capped_return, is_spike, usable, used_price
from pricetide.params import Methodology

VARIANT = ["cm_product_id", "variant_key"]


def index_days(calendar: DataFrame, members: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each observation day of an index with the rebalance in force.

    As-of lookup by a running last over the union of calendar days and rebalance
    dates (both bounded by the calendar); days before the first rebalance drop out.
    """
    games = definitions.select("index_code", "game_key")
    days = calendar.join(games, "game_key").select(
        "index_code", "value_date", "unchanged", F.lit(None).cast("date").alias("eff"), F.lit(True).alias("is_day")
    )
    steps = members.select("index_code", "effective_date").distinct().select(
        "index_code",
        F.col("effective_date").alias("value_date"),
        F.lit(None).cast("boolean").alias("unchanged"),
        F.col("effective_date").alias("eff"),
        F.lit(False).alias("is_day"),
    )
    # A rebalance dated on an observation day already applies to it.
    order = (
        Window.partitionBy("index_code")
        .orderBy("value_date")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        days.unionByName(steps)
        .withColumn("effective_date", F.max("eff").over(order))
        .filter(F.col("is_day") & F.col("effective_date").isNotNull())
        .select("index_code", "value_date", "unchanged", "effective_date")
    )


def member_panel(
    prices: DataFrame,
    members: DataFrame,
    calendar: DataFrame,
    definitions: DataFrame,
    method: Methodology,
    last_by: str | None = None,
) -> DataFrame:
    """One row per index, observation day and member, with the day's price if any.

    Prices are cut to variants that were ever members before anything is
    shuffled by day. Prices hold one row per variant and day; where they may not,
    `last_by` names a scalar column whose greatest value marks the row to keep.
    """
    games = definitions.select("index_code", "game_key")
    panel = (
        index_days(calendar, members, definitions)
        .join(
            members.select("index_code", "effective_date", *VARIANT, "stable_variant_id"),
            ["index_code", "effective_date"],
        )
        .join(games, "index_code")
    )
    key = ["game_key", *VARIANT]
    # At most target size x rebalances distinct members, whatever the price volume.
    ever_members = members.join(games, "index_code").select(*key).distinct()
    price = used_price(F.col(method.price_field_primary), F.col(method.price_field_fallback))
    cut = prices.join(ever_members, key, "left_semi").withColumn("used_price", price)
    # Fixed-width buffers, so this stays a hash aggregation with a map-side part.
    last = F.max_by("used_price", last_by) if last_by else F.max("used_price")
    daily = cut.groupBy(*key, "value_date").agg(last.alias("used_price"))
    return panel.join(daily, [*key, "value_date"], "left")


def member_state(panel: DataFrame, method: Methodology, carry: DataFrame | None = None) -> DataFrame:
    """The panel with each row's observed and previous price, missing run and capped return."""
    if carry is None:
        panel = panel.withColumn("carried_price", F.lit(None).cast("double")).withColumn("carried_run", F.lit(None).cast("bigint"))
    else:
        panel = panel.join(carry, ["index_code", *VARIANT], "left")
    path = Window.partitionBy("index_code", *VARIANT).orderBy("value_date")
    history = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = path.rowsBetween(Window.unboundedPreceding, -1)
    price = F.when(~F.col("unchanged"), usable(F.col("used_price")))
    missed = F.when(F.col("observed").isNull() & ~F.col("unchanged"), 1).otherwise(0)
    return (
        panel.withColumn("observed", price)
        .withColumn("previous", F.coalesce(F.last("observed", ignorenulls=True).over(before), "carried_price"))
        .withColumn("missed_so_far", F.sum(missed).over(history))
        .withColumn(
            "missed_at_observation",
            F.coalesce(
                F.last(F.when(F.col("observed").isNotNull(), F.col("missed_so_far")), ignorenulls=True).over(history),
                -F.col("carried_run"),
            ),
        )
        .withColumn("missing_run", F.col("missed_so_far") - F.col("missed_at_observation"))
        .withColumn("raw_return", F.col("observed") / F.col("previous") - 1)
        .withColumn("capped", capped_return(F.col("raw_return"), method.daily_return_cap))
    )


def member_carry(panel: DataFrame, method: Methodology, carry: DataFrame | None = None) -> DataFrame:
    """What later days need of these: per member the last observed price and the missing run.

    A row (index_code, product, variant, carried_price, carried_run) for each member that was ever
    observed; members without rows keep what they had.
    """
    keys = ["index_code", *VARIANT]
    after = (
        member_state(panel, method, carry)
        .groupBy(*keys)
        .agg(
            F.max_by(F.coalesce("observed", "previous"), "value_date").alias("carried_price"),
            F.max_by(F.coalesce("missing_run", F.lit(0)), "value_date").cast("bigint").alias("carried_run"),
        )
        .filter(F.col("carried_price").isNotNull())
    )
    return after if carry is None else carry.join(after, keys, "left_anti").unionByName(after)


def flag_members(panel: DataFrame, method: Methodology, carry: DataFrame | None = None) -> DataFrame:
    """Return and flag of every member row; state survives rebalances.

    State is expressed over the member rows of one variant in one index (at most
    one row per calendar day): the last observed price, and the number of missing
    days since then. `carry` (member_carry of earlier days) goes before the rows.
    """
    state = member_state(panel, method, carry)
    seen = F.col("previous").isNotNull()
    flag = (
        F.when(F.col("unchanged"), F.when(seen, "snapshot_unchanged"))
        .when(F.col("observed").isNotNull() & ~seen, "initialized")
        .when(
            F.col("observed").isNotNull(),
            F.when(is_spike(F.col("raw_return"), F.col("capped")), "spike_capped").otherwise("fresh"),
        )
        .when(seen & (F.col("missing_run") <= method.carry_forward_max_days), "carried_forward")
        .otherwise("stale")
    )
    return (
        state.withColumn("flag", flag)
        .filter(F.col("flag").isNotNull())
        .select(
            "index_code",
            "value_date",
            "effective_date",
            "unchanged",
            "stable_variant_id",
            *VARIANT,
            "missing_run",
            F.when(F.col("flag").isin("fresh", "spike_capped"), F.col("capped"))
            .otherwise(F.lit(0.0))
            .alias("used_return"),
            "flag",
        )
    )


def is_active() -> Column:
    return F.col("flag") != "stale"


def contributions(flagged: DataFrame) -> DataFrame:
    """Equal weight and contribution of every active member row."""
    day = Window.partitionBy("index_code", "value_date")
    return (
        flagged.filter(is_active())
        .withColumn("weight", 1.0 / F.count(F.lit(1)).over(day))
        .select(
            "index_code",
            "value_date",
            "stable_variant_id",
            *VARIANT,
            "weight",
            "used_return",
            (F.col("weight") * F.col("used_return")).alias("contribution"),
            "flag",
        )
    )


def daily_returns(flagged: DataFrame) -> DataFrame:
    """Mean return and flag counts per index and day; days without active members drop out."""
    return (
        flagged.groupBy("index_code", "value_date")
        .agg(
            F.avg(F.when(is_active(), F.col("used_return"))).alias("daily_return"),
            F.count_if(is_active()).alias("n_constituents_active"),
            F.count_if(F.col("flag") == "spike_capped").alias("n_capped"),
            F.count_if(F.col("flag").isin("carried_forward", "snapshot_unchanged")).alias(
                "n_carried_forward"
            ),
            F.count_if(F.col("flag") == "stale").alias("n_stale"),
            F.max("unchanged").alias("whole_market_carried_forward"),
            F.max("effective_date").alias("rebalance_effective_date"),
        )
        .filter(F.col("n_constituents_active") > 0)
    )


def link(returns: DataFrame, definitions: DataFrame, method: Methodology) -> DataFrame:
    """Index level: base value times the running product of (1 + return)."""
    # One row per index and day: the window holds a calendar, not the prices.
    path = (
        Window.partitionBy("index_code")
        .orderBy("value_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    base = definitions.select("index_code", "base_value")
    return (
        returns.join(base, "index_code")
        .withColumn("index_value", F.col("base_value") * F.product(1 + F.col("daily_return")).over(path))
        .select(
            "index_code",
            "value_date",
            "index_value",
            "daily_return",
            "n_constituents_active",
            "n_capped",
            "n_carried_forward",
            "n_stale",
            "whole_market_carried_forward",
            "rebalance_effective_date",
            F.lit(method.methodology_version).alias("calc_version"),
        )
    )


def calculate_chain_linked(
    prices: DataFrame,
    members: DataFrame,
    calendar: DataFrame,
    definitions: DataFrame,
    method: Methodology,
) -> tuple[DataFrame, DataFrame]:
    """(daily values, contributions) of all indexes."""
    flagged = flag_members(member_panel(prices, members, calendar, definitions, method), method)
    return link(daily_returns(flagged), definitions, method), contributions(flagged)


def price_calendar(prices: DataFrame) -> DataFrame:
    """Calendar of the days that carry prices, none of them unchanged."""
    return prices.select("game_key", "value_date").distinct().withColumn("unchanged", F.lit(False))


def calculate_daily_values(
    prices: DataFrame,
    constituents: DataFrame,
    definitions: DataFrame,
    method: Methodology,
    start_value: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index over one fixed selection that starts on each game's first price day."""
    if start_value is not None:
        definitions = definitions.withColumn("base_value", F.lit(float(start_value)))
    first = prices.groupBy("game_key").agg(F.min("value_date").alias("effective_date"))
    games = definitions.select("index_code", "game_key")
    members = (
        constituents.select("index_code", *VARIANT, "stable_variant_id")
        .join(games, "index_code")
        .join(first, "game_key")
        .drop("game_key")
    )
    return calculate_chain_linked(prices, members, price_calendar(prices), definitions, method)
