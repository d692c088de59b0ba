"""Holdings against constituents and a benchmark index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.merge import keep_last


def constituent_lookup(intervals: DataFrame, order: list[str]) -> DataFrame:
    """Constituents of all indexes as one lookup by (product, variant); the last by `order` wins."""
    return keep_last(
        intervals.select("cm_product_id", "variant_key", "ref_price", *order),
        ["cm_product_id", "variant_key"],
        order,
    ).select("cm_product_id", "variant_key", "ref_price")


def mark_duplicates(holdings: DataFrame) -> DataFrame:
    """Valid lines after the first of the same product and variant are `Duplicate` errors.

    A minimum per key instead of a numbering, so that a repeated key is reduced
    before the shuffle; invalid lines take no part.
    """
    key = ["portfolio_id", "cm_product_id", "variant_key"]
    first = (
        holdings.filter(F.col("error").isNull()).groupBy(*key).agg(F.min("line").alias("first_line"))
    )
    return (
        holdings.join(first, key, "left")
        .withColumn(
            "error",
            F.coalesce(
                "error",
                F.when(F.col("line") > F.col("first_line"), "Duplicate product and variant"),
            ),
        )
        .drop("first_line")
    )


def validate(holdings: DataFrame, lookup: DataFrame) -> DataFrame:
    """All lines with their error, or (accepted) with market and cost value, 2 places."""
    marked = mark_duplicates(holdings)
    matched = marked.join(
        lookup.withColumn("_hit", F.lit(True)), ["cm_product_id", "variant_key"], "left"
    )
    unmatched = F.when(
        F.col("_hit").isNull(),
        F.concat(
            F.lit("Unmatched Cardmarket product "),
            F.col("cm_product_id").cast("string"),
            F.lit(" ("),
            F.col("variant_key"),
            F.lit(")"),
        ),
    )
    error = F.coalesce(F.col("error"), unmatched)
    accepted = error.isNull()
    return matched.select(
        "portfolio_id",
        "line",
        error.alias("error"),
        "cm_product_id",
        "variant_key",
        "quantity",
        F.when(accepted, F.round(F.col("ref_price") * F.col("quantity"), 2)).alias("market_value_eur"),
        F.when(accepted, F.round(F.col("cost_basis_eur") * F.col("quantity"), 2)).alias(
            "cost_basis_value_eur"
        ),
    )


def benchmark_window(history: DataFrame, basis: Column | None) -> DataFrame:
    """Rows from the basis day on; the whole history of an index that has none there."""
    if basis is None:
        return history
    hits = F.count(F.when(F.col("value_date") >= basis, 1)).over(Window.partitionBy("index_code"))
    return (
        history.withColumn("_hits", hits)
        .filter((F.col("_hits") == 0) | (F.col("value_date") >= basis))
        .drop("_hits")
    )


def benchmark_ends(history: DataFrame, basis: Column | None) -> DataFrame:
    """First and last point of the benchmark window per index."""
    return benchmark_window(history, basis).groupBy("index_code").agg(
        F.min("value_date").alias("first_date"),
        F.max("value_date").alias("last_date"),
        F.min_by("index_value", "value_date").alias("first_value"),
        F.max_by("index_value", "value_date").alias("last_value"),
    )


def totals(validated: DataFrame) -> DataFrame:
    """Market value and cost basis of each portfolio's accepted lines."""
    return (
        validated.filter(F.col("error").isNull())
        .groupBy("portfolio_id")
        .agg(
            F.sum("market_value_eur").alias("market"),
            F.sum(F.coalesce("cost_basis_value_eur", F.lit(0.0))).alias("cost"),
            F.bool_or(F.col("cost_basis_value_eur").isNotNull()).alias("has_cost"),
        )
    )


def summarize(
    validated: DataFrame, history: DataFrame, choices: DataFrame, basis: Column | None = None
) -> DataFrame:
    """Each portfolio against its chosen benchmark: returns and relative percentage points.

    `choices` holds (portfolio_id, index_code), usually one benchmark per portfolio.
    """
    ends = benchmark_ends(history, basis)
    portfolio = F.when(F.col("has_cost") & (F.col("cost") > 0), F.col("market") / F.col("cost") - 1)
    benchmark = F.col("last_value") / F.col("first_value") - 1
    return (
        totals(validated)
        .join(choices.select("portfolio_id", "index_code"), "portfolio_id")
        .join(ends, "index_code")
        .select(
            "portfolio_id",
            "index_code",
            "first_date",
            "last_date",
            F.round("market", 2).alias("latest_market_value"),
            F.when(F.col("has_cost"), F.round("cost", 2)).alias("provided_cost_basis"),
            portfolio.alias("portfolio_return"),
            benchmark.alias("benchmark_return"),
            F.round((portfolio - benchmark) * 100, 2).alias("relative_pp"),
        )
    )


def comparison(summary: DataFrame) -> DataFrame:
    """Two points per portfolio and benchmark, both rebased to 1000; none without a cost basis."""
    p_end = 1000 * (1 + F.col("portfolio_return"))
    b_end = 1000 * (1 + F.col("benchmark_return"))
    start = F.struct(
        F.col("first_date").alias("value_date"),
        F.lit(1000.0).alias("portfolio"),
        F.lit(1000.0).alias("benchmark"),
        F.lit(0.0).alias("relative_pct"),
    )
    end = F.struct(
        F.col("last_date").alias("value_date"),
        F.round(p_end, 2).alias("portfolio"),
        F.round(b_end, 2).alias("benchmark"),
        F.round((p_end / b_end - 1) * 100, 2).alias("relative_pct"),
    )
    return (
        summary.filter(F.col("portfolio_return").isNotNull())
        .select("portfolio_id", "index_code", F.posexplode(F.array(start, end)).alias("point", "p"))
        .select("portfolio_id", "index_code", "point", "p.*")
    )


def benchmark_series(history: DataFrame, basis: Column | None = None) -> DataFrame:
    """Benchmark window rebased to 1000 at its first day, 2 places."""
    path = Window.partitionBy("index_code").orderBy("value_date")
    return benchmark_window(history, basis).select(
        "index_code",
        "value_date",
        F.round(F.col("index_value") / F.first("index_value").over(path) * 1000, 2).alias("benchmark"),
    )
