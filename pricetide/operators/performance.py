"""Index history queries: ranges, changes, drawdown, summaries, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Chart ranges in calendar days.
RANGE_DAYS = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365}


def _by_date() -> Window:
    return Window.partitionBy("index_code").orderBy("value_date")


def post_inception(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """History from each index's base date on."""
    base = definitions.select("index_code", "base_date")
    return history.join(base, "index_code").filter(F.col("value_date") >= F.col("base_date")).drop("base_date")


def validation_rows(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """Number of rows before the base date per index."""
    base = definitions.select("index_code", "base_date")
    return (
        history.join(base, "index_code")
        .groupBy("index_code")
        .agg(F.count_if(F.col("value_date") < F.col("base_date")).alias("validation_rows"))
    )


def published(definitions: DataFrame) -> DataFrame:
    """Definitions whose status and history provenance are both published."""
    return definitions.filter(
        (F.col("status") == "published") & (F.col("history_start_kind") == "published")
    )


def usable_for_portfolios(definitions: DataFrame, history: DataFrame) -> DataFrame:
    """Published definitions that have at least one history row."""
    return definitions.filter(F.col("status") == "published").join(
        history.select("index_code"), "index_code", "left_semi"
    )


def chart_range(history: DataFrame, label: str) -> DataFrame:
    """Rows of a chart range counted back from each index's latest observation."""
    if label == "Max":
        return history
    days = RANGE_DAYS[label]
    latest = F.max("value_date").over(Window.partitionBy("index_code"))
    return (
        history.withColumn("_latest", latest)
        .filter(F.col("value_date") >= F.date_sub("_latest", days))
        .drop("_latest")
    )


def chart_ranges(history: DataFrame) -> DataFrame:
    """Every row once for each chart range that it is in, named in `range`; one pass."""
    latest = F.max("value_date").over(Window.partitionBy("index_code"))
    ranges = F.array(
        *(
            F.when(F.col("value_date") >= F.date_sub("_latest", days), F.lit(label))
            for label, days in RANGE_DAYS.items()
        ),
        F.lit("Max"),
    )
    return (
        history.withColumn("_latest", latest)
        .withColumn("range", F.explode(F.array_compact(ranges)))
        .drop("_latest")
    )


def last_observations(history: DataFrame, n: int) -> DataFrame:
    """The last `n` rows of each index."""
    newest = Window.partitionBy("index_code").orderBy(F.desc("value_date"))
    return history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def chart_points(history: DataFrame) -> DataFrame:
    """Chart values: index value and drawdown percent against the running peak, 2 places."""
    peak = F.max("index_value").over(_by_date())
    return history.select(
        "index_code",
        "value_date",
        F.round("index_value", 2).alias("value"),
        F.round((F.col("index_value") / peak - 1) * 100, 2).alias("drawdown"),
    )


def changes(history: DataFrame, steps: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Change over the last n rows of each index, clamped to the first row; 0 below two rows."""
    first = F.first("index_value").over(_by_date())
    out = history.withColumn("_rn", F.row_number().over(Window.partitionBy("index_code").orderBy(F.desc("value_date"))))
    for n in steps:
        before = F.coalesce(F.lag("index_value", n).over(_by_date()), first)
        out = out.withColumn(f"d{n}", F.col("index_value") / before - 1)
    return out.filter(F.col("_rn") == 1).select("index_code", *[f"d{n}" for n in steps])


def recent_volatility(history: DataFrame, rows: int = 30) -> DataFrame:
    """Population volatility of the last rows, annualised; 0 below two rows."""
    return (
        last_observations(history, rows)
        .groupBy("index_code")
        .agg(
            F.when(
                F.count(F.lit(1)) >= 2, F.stddev_pop("daily_return") * F.sqrt(F.lit(365.0))
            )
            .otherwise(F.lit(0.0))
            .alias("annualized_volatility_30d")
        )
    )


def summary(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per index: period, return, drawdown, best and worst day, volatility, flagged days.

    Indexes without history get an empty summary with zero figures.
    """
    order = F.struct("daily_return", -F.unix_date("value_date"))
    worst_order = F.struct("daily_return", F.unix_date("value_date"))
    base = history.groupBy("index_code").agg(
        F.min("value_date").alias("start_date"),
        F.max("value_date").alias("end_date"),
        F.count(F.lit(1)).alias("observation_count"),
        (F.max_by("index_value", "value_date") / F.min_by("index_value", "value_date") - 1).alias(
            "period_return"
        ),
        F.max_by("value_date", order).alias("best_day"),
        F.min_by("value_date", worst_order).alias("worst_day"),
        F.avg((F.col("daily_return") > 0).cast("double")).alias("positive_day_ratio"),
        F.count_if(F.col("n_capped") > 0).alias("capped_days"),
        F.count_if(F.col("n_carried_forward") > 0).alias("carried_forward_days"),
    )
    drawdown = (
        chart_points(history)
        .groupBy("index_code")
        .agg((F.min("drawdown") / 100).alias("max_drawdown"))
    )
    return (
        definitions.select("index_code")
        .join(base, "index_code", "left")
        .join(drawdown, "index_code", "left")
        .join(recent_volatility(history), "index_code", "left")
        .fillna(
            0,
            [
                "observation_count",
                "period_return",
                "positive_day_ratio",
                "capped_days",
                "carried_forward_days",
                "max_drawdown",
                "annualized_volatility_30d",
            ],
        )
    )


def current_version(values: DataFrame, version: str = "calc_version") -> DataFrame:
    """One row per index and day: the greatest calculation version (text order)."""
    rest = [c for c in values.columns if c not in ("index_code", "value_date")]
    return (
        values.groupBy("index_code", "value_date")
        .agg(F.max_by(F.struct(*rest), version).alias("r"))
        .select("index_code", "value_date", "r.*")
    )


def history_csv_rows(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """Publishable history rows as text columns; unpublished indexes have none."""
    return (
        history.join(
            definitions.filter(F.col("status") == "published").select("index_code"),
            "index_code",
            "left_semi",
        )
        .select(
            "index_code",
            F.col("value_date").cast("string").alias("value_date"),
            F.format_string("%.6f", F.col("index_value")).alias("index_value"),
            F.format_string("%.8f", F.col("daily_return")).alias("daily_return"),
            F.col("n_constituents_active").cast("string").alias("n_constituents_active"),
            F.coalesce("n_capped", F.lit(0)).cast("string").alias("n_capped"),
            F.coalesce("n_carried_forward", F.lit(0)).cast("string").alias("n_carried_forward"),
            F.coalesce("calc_version", F.lit("")).alias("calc_version"),
        )
    )


def search_records(definitions: DataFrame, history: DataFrame) -> DataFrame:
    """Search table: the latest value is the score of a published index."""
    latest = history.groupBy("index_code").agg(F.max_by("index_value", "value_date").alias("latest"))
    return definitions.join(latest, "index_code", "left").select(
        F.col("index_code").alias("id"),
        "name",
        F.when(F.col("status") == "published", F.col("latest")).alias("score"),
        F.col("universe").alias("category"),
        "status",
        "target_size",
    )


def public_summaries(definitions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Definitions with their metrics; unpublished indexes show zeroed metrics."""
    shown = (F.col("status") == "published") & (F.col("history_start_kind") == "published")
    return (
        definitions.join(metrics.select("index_code", "breadth", "volatility_30d"), "index_code", "left")
        .withColumn("breadth", F.when(shown, F.col("breadth")).otherwise(F.lit(0.0)))
        .withColumn("volatility_30d", F.when(shown, F.col("volatility_30d")).otherwise(F.lit(0.0)))
    )


def status_rollup(definitions: DataFrame, history: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per index freshness plus the overall last day and the number of gaps."""
    fresh = history.groupBy("index_code").agg(F.max("value_date").alias("freshness"))
    return (
        definitions.select("index_code", "status")
        .join(fresh, "index_code", "left")
        .withColumn("last_calc_date", history.agg(F.max("value_date")).scalar())
        .withColumn("gap_count", gaps.agg(F.count(F.lit(1))).scalar())
    )


def with_history(definitions: DataFrame, history: DataFrame) -> DataFrame:
    """Each definition with its history as a date-ordered array (one entry per calendar day)."""
    rows = history.groupBy("index_code").agg(
        F.sort_array(F.collect_list(F.struct("value_date", "index_value", "daily_return"))).alias("history")
    )
    return definitions.join(rows, "index_code", "left")
