"""Daily analytics: drawdown, volatility, breadth, movers and contribution ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (1, 7, 30)
# Ranking name -> (ranked column, descending).
RANKINGS = {
    "top_movers": ("compounded_return", True),
    "bottom_movers": ("compounded_return", False),
    "contribution_leaders": ("contribution", True),
    "contribution_laggards": ("contribution", False),
}
_ROW = ["index_code", "stable_variant_id", "cm_product_id", "variant_key"]


def check_arguments(windows: Sequence[int], ranking_limit: int) -> None:
    if any(w <= 0 for w in windows):
        raise ValueError("analytics windows must be positive")
    if ranking_limit <= 0:
        raise ValueError("ranking_limit must be positive")


def trailing_days(n: int, *keys: str) -> Window:
    """The last `n` calendar days up to and including the row's day."""
    return (
        Window.partitionBy(*keys).orderBy(F.unix_date("value_date")).rangeBetween(-(n - 1), 0)
    )


def market_rows(values: DataFrame, contributions: DataFrame) -> DataFrame:
    """Contribution rows that count in windows: not on whole-market carried days and
    not carried over from an unchanged snapshot."""
    open_days = values.filter(~F.col("whole_market_carried_forward")).select("index_code", "value_date")
    return contributions.filter(F.col("flag") != "snapshot_unchanged").join(
        open_days, ["index_code", "value_date"], "left_semi"
    )


def variant_windows(
    values: DataFrame, contributions: DataFrame, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Compounded return, contribution and observation days of each variant in the
    trailing windows of each value date.

    A variant belongs to a value date's window when it has a row in it, also when
    that row is older than the date itself. Each row is therefore repeated only on
    the following days that lack a row of their own, up to the longest window, and
    range frames do the rest: one shuffle by (index, variant), against one copy
    per covered day if every row were sent to every window.
    """
    longest = max(windows)
    rows = market_rows(values, contributions).select(*_ROW, "value_date", "used_return", "contribution")
    series = Window.partitionBy(*_ROW).orderBy("value_date")
    until = F.least(
        F.coalesce(F.date_sub(F.lead("value_date").over(series), 1), F.date_add("value_date", longest - 1)),
        F.date_add("value_date", longest - 1),
    )
    spread = (
        rows.withColumn("until", until)
        .withColumn("day", F.explode(F.sequence("value_date", "until", F.expr("interval 1 day"))))
        .withColumn("own", F.col("day") == F.col("value_date"))
        .select(
            *_ROW,
            F.col("day").alias("value_date"),
            F.when(F.col("own"), F.col("used_return")).alias("used_return"),
            F.when(F.col("own"), F.col("contribution")).alias("contribution"),
        )
    )
    frames = []
    for w in windows:
        span = trailing_days(w, *_ROW)
        frames.append(
            F.struct(
                F.lit(w).alias("window_days"),
                (F.product(1 + F.col("used_return")).over(span) - 1).alias("compounded_return"),
                F.sum("contribution").over(span).alias("contribution"),
                F.count("used_return").over(span).alias("observation_days"),
            )
        )
    wide = spread.select(*_ROW, "value_date", *[f.alias(f"w{i}") for i, f in enumerate(frames)])
    dates = values.select("index_code", "value_date")
    return (
        wide.join(dates, ["index_code", "value_date"], "left_semi")
        .select(
            *_ROW, "value_date", F.explode(F.array(*[F.col(f"w{i}") for i in range(len(frames))])).alias("w")
        )
        .select(*_ROW, "value_date", "w.*")
        .filter(F.col("observation_days") > 0)
    )


def window_counts(
    values: DataFrame, contributions: DataFrame, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Per value date and window: dates with rows, and excluded whole-market dates."""
    observed = (
        market_rows(values, contributions)
        .select("index_code", "value_date")
        .distinct()
        .withColumn("has_rows", F.lit(1))
    )
    days = values.select("index_code", "value_date", "whole_market_carried_forward").join(
        observed, ["index_code", "value_date"], "left"
    )
    counts = [
        F.struct(
            F.lit(w).alias("window_days"),
            F.date_sub("value_date", w - 1).alias("start_date"),
            F.coalesce(F.sum("has_rows").over(trailing_days(w, "index_code")), F.lit(0)).alias(
                "observation_dates"
            ),
            F.sum(F.col("whole_market_carried_forward").cast("bigint"))
            .over(trailing_days(w, "index_code"))
            .alias("excluded_whole_market_dates"),
        ).alias(f"w{w}")
        for w in windows
    ]
    wide = days.select("index_code", "value_date", *counts)
    return wide.select(
        "index_code", "value_date", F.explode(F.array(*[F.col(f"w{w}") for w in windows])).alias("w")
    ).select("index_code", "value_date", "w.*")


def with_names(rows: DataFrame, products: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add product_name, falling back to `Product <id>`."""
    names = products.select("game_key", "cm_product_id", F.col("name").alias("product_name"))
    games = definitions.select("index_code", "game_key")
    fallback = F.concat(F.lit("Product "), F.col("cm_product_id").cast("string"))
    return (
        rows.join(games, "index_code")
        .join(names, ["game_key", "cm_product_id"], "left")
        .withColumn("product_name", F.coalesce("product_name", fallback))
        .drop("game_key")
    )


def rankings(per_variant: DataFrame, limit: int = 10) -> DataFrame:
    """The four ranked lists per index, date and window, flat: (ranking, rank, variant, value).

    A group holds the variants of one index in one window: at most the members of
    the rebalances it touches. All four orders share one shuffle.
    """
    group = Window.partitionBy("index_code", "value_date", "window_days")

    def place(column: str, down: bool) -> Column:
        first = F.desc(column) if down else F.asc(column)
        return F.row_number().over(group.orderBy(first, F.asc("stable_variant_id")))

    placed = per_variant.select(
        "*", *[place(c, down).alias(name) for name, (c, down) in RANKINGS.items()]
    )
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(name) <= limit,
                    F.struct(
                        F.lit(name).alias("ranking"),
                        F.col(name).alias("rank"),
                        F.col(column).alias("value"),
                    ),
                )
                for name, (column, _) in RANKINGS.items()
            ]
        )
    )
    return placed.select(
        "index_code",
        "value_date",
        "window_days",
        F.explode(entries).alias("e"),
        "stable_variant_id",
        "cm_product_id",
        "variant_key",
        "observation_days",
    ).select("index_code", "value_date", "window_days", "e.*", "stable_variant_id", "cm_product_id", "variant_key", "observation_days")


def drawdown_and_volatility(values: DataFrame) -> DataFrame:
    """Running peak drawdown and 30-calendar-day annualised sample volatility."""
    path = (
        Window.partitionBy("index_code")
        .orderBy("value_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    month = trailing_days(30, "index_code")
    peak = F.max("index_value").over(path)
    return values.select(
        "index_code",
        "value_date",
        "index_value",
        "daily_return",
        F.when(peak > 0, F.col("index_value") / peak - 1).otherwise(F.lit(0.0)).alias("drawdown"),
        (F.stddev_samp("daily_return").over(month) * F.sqrt(F.lit(365.0))).alias("volatility_30d"),
        F.count("daily_return").over(month).alias("volatility_observations"),
        "whole_market_carried_forward",
    )


def breadth(per_variant: DataFrame, window: int = 7) -> DataFrame:
    """Share of a window's variants with a positive compounded return."""
    return (
        per_variant.filter(F.col("window_days") == window)
        .groupBy("index_code", "value_date")
        .agg(
            F.avg((F.col("compounded_return") > 0).cast("double")).alias("breadth_7d"),
            F.count(F.lit(1)).alias("breadth_observations"),
        )
    )


def daily_analytics(
    values: DataFrame, per_variant: DataFrame
) -> DataFrame:
    """One row per index and date: drawdown, volatility and breadth."""
    return (
        drawdown_and_volatility(values)
        .join(breadth(per_variant), ["index_code", "value_date"], "left")
        .fillna({"breadth_observations": 0})
    )


def window_summary(values: DataFrame, contributions: DataFrame, per_variant: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Window header rows: dates, exclusions and number of variants."""
    sizes = per_variant.groupBy("index_code", "value_date", "window_days").agg(
        F.count(F.lit(1)).alias("constituent_observations")
    )
    return (
        window_counts(values, contributions, windows)
        .join(sizes, ["index_code", "value_date", "window_days"], "left")
        .fillna({"constituent_observations": 0})
    )


def calculate_analytics(
    values: DataFrame,
    contributions: DataFrame,
    products: DataFrame,
    definitions: DataFrame,
    windows: Sequence[int] = WINDOWS,
    ranking_limit: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily rows, window rows, ranked rows) of all indexes."""
    check_arguments(windows, ranking_limit)
    per_variant = variant_windows(values, contributions, windows)
    ranked = with_names(rankings(per_variant, ranking_limit), products, definitions)
    return (
        daily_analytics(values, per_variant),
        window_summary(values, contributions, per_variant, windows),
        ranked,
    )


def nested_analytics(daily: DataFrame, window_rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Analytics as one nested row per index and date (windows with four ranked lists).

    Lists hold at most `ranking_limit` entries and windows at most the window
    tuple, so the collected groups are bounded by parameters.
    """
    keys = ["index_code", "value_date", "window_days"]
    entry = F.struct(
        "rank", "stable_variant_id", "cm_product_id", "variant_key", "product_name", "value", "observation_days"
    )
    lists = ranked.groupBy(*keys).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("ranking") == name, entry))).alias(name)
            for name in RANKINGS
        ]
    )
    windows = (
        window_rows.join(lists, keys, "left")
        .groupBy("index_code", "value_date")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "window_days",
                        "start_date",
                        "observation_dates",
                        "excluded_whole_market_dates",
                        "constituent_observations",
                        *RANKINGS,
                    )
                )
            ).alias("windows")
        )
    )
    return daily.join(windows, ["index_code", "value_date"], "left")
