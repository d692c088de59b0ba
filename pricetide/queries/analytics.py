"""Analytics queries over the chain-linked index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import analytics
from pricetide.queries import views
from pricetide.queries.registry import query

views.SQL.update(
    {
        "market_rows": (
            ["contributions", "daily_values"],
            """SELECT c.* FROM contributions c JOIN daily_values v USING (index_code, value_date)
            WHERE NOT v.whole_market_carried_forward AND c.flag <> 'snapshot_unchanged'""",
        ),
        "variant_windows": (
            ["market_rows", "daily_values"],
            """SELECT v.index_code, v.value_date, w.n AS window_days, c.stable_variant_id, c.cm_product_id, c.variant_key,
            product(1 + c.used_return ORDER BY c.value_date) - 1 AS compounded_return, sum(c.contribution ORDER BY c.value_date) AS contribution, count(*) AS observation_days
            FROM daily_values v CROSS JOIN (VALUES (1), (7), (30)) w(n)
            JOIN market_rows c ON c.index_code = v.index_code AND c.value_date BETWEEN v.value_date - (w.n - 1) AND v.value_date
            GROUP BY ALL""",
        ),
    }
)


def _windows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checkpointed values and contributions, and the per-variant windows."""
    from pricetide.operators import chain
    from pricetide.session import cut_lineage

    rows = cut_lineage(views.flagged(spark, sf))
    values = chain.link(chain.daily_returns(rows), views.definitions(spark), views.METHOD)
    contributions = chain.contributions(rows)
    return values, contributions, analytics.variant_windows(values, contributions)


@query(
    "variant_window_returns",
    "A4 J6",
    "index_code:s value_date:s window_days:i stable_variant_id:s compounded_return:f8 contribution:f8 observation_days:i",
    "SELECT * FROM variant_windows",
    ["variant_windows"],
)
def variant_window_returns(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf)[2]


@query(
    "window_date_counts",
    "A5 J6",
    "index_code:s value_date:s window_days:i start_date:s observation_dates:i excluded_whole_market_dates:i constituent_observations:i",
    """SELECT v.index_code, v.value_date, w.n AS window_days, v.value_date - (w.n - 1) AS start_date,
    (SELECT count(DISTINCT m.value_date) FROM market_rows m WHERE m.index_code = v.index_code AND m.value_date BETWEEN v.value_date - (w.n - 1) AND v.value_date) AS observation_dates,
    (SELECT count(*) FROM daily_values x WHERE x.index_code = v.index_code AND x.whole_market_carried_forward AND x.value_date BETWEEN v.value_date - (w.n - 1) AND v.value_date) AS excluded_whole_market_dates,
    (SELECT count(*) FROM variant_windows p WHERE p.index_code = v.index_code AND p.value_date = v.value_date AND p.window_days = w.n) AS constituent_observations
    FROM daily_values v CROSS JOIN (VALUES (1), (7), (30)) w(n)""",
    ["daily_values", "market_rows", "variant_windows"],
)
def window_date_counts(spark: SparkSession, sf: str) -> DataFrame:
    values, contributions, per_variant = _windows(spark, sf)
    return analytics.window_summary(values, contributions, per_variant)


@query(
    "daily_analytics",
    "D5 A6 W5 W6",
    "index_code:s value_date:s index_value:f4 drawdown:f8 volatility_30d:f6 volatility_observations:i breadth_7d:f8 breadth_observations:i whole_market_carried_forward:b",
    """SELECT v.index_code, v.value_date, v.index_value, v.whole_market_carried_forward,
    v.index_value / max(v.index_value) OVER (PARTITION BY v.index_code ORDER BY v.value_date) - 1 AS drawdown,
    stddev_samp(v.daily_return) OVER w30 * sqrt(365) AS volatility_30d, count(*) OVER w30 AS volatility_observations, b.breadth_7d, coalesce(b.n, 0) AS breadth_observations
    FROM daily_values v LEFT JOIN (SELECT index_code, value_date, avg(CASE WHEN compounded_return > 0 THEN 1.0 ELSE 0.0 END) AS breadth_7d, count(*) AS n
         FROM variant_windows WHERE window_days = 7 GROUP BY 1, 2) b ON b.index_code = v.index_code AND b.value_date = v.value_date
    WINDOW w30 AS (PARTITION BY v.index_code ORDER BY v.value_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
    ["daily_values", "variant_windows"],
)
def daily_analytics(spark: SparkSession, sf: str) -> DataFrame:
    values, _, per_variant = _windows(spark, sf)
    return analytics.daily_analytics(values, per_variant)


@query(
    "ranked_movers",
    "T3 J7 D5",
    "index_code:s value_date:s window_days:i ranking:s rank:i stable_variant_id:s product_name:s value:f8 observation_days:i",
    """SELECT r.index_code, r.value_date, r.window_days, r.ranking, r.rank, r.stable_variant_id, coalesce(p.name, 'Product ' || r.cm_product_id) AS product_name, r.value, r.observation_days
    FROM (SELECT *, 'top_movers' AS ranking, compounded_return AS value, row_number() OVER (PARTITION BY index_code, value_date, window_days ORDER BY compounded_return DESC, stable_variant_id) AS rank FROM variant_windows
      UNION ALL SELECT *, 'bottom_movers', compounded_return, row_number() OVER (PARTITION BY index_code, value_date, window_days ORDER BY compounded_return, stable_variant_id) FROM variant_windows
      UNION ALL SELECT *, 'contribution_leaders', contribution, row_number() OVER (PARTITION BY index_code, value_date, window_days ORDER BY contribution DESC, stable_variant_id) FROM variant_windows
      UNION ALL SELECT *, 'contribution_laggards', contribution, row_number() OVER (PARTITION BY index_code, value_date, window_days ORDER BY contribution, stable_variant_id) FROM variant_windows) r
    JOIN definitions d USING (index_code) LEFT JOIN products p ON p.game_key = d.game_key AND p.cm_product_id = r.cm_product_id AND p.cm_product_id % 9 <> 0
    WHERE r.rank <= 3""",
    ["variant_windows", "definitions", "products"],
)
def ranked_movers(spark: SparkSession, sf: str) -> DataFrame:
    per_variant = _windows(spark, sf)[2]
    known = views.products(spark, sf).filter(F.col("cm_product_id") % 9 != 0)
    return analytics.with_names(analytics.rankings(per_variant, 3), known, views.definitions(spark))


@query(
    "nested_analytics",
    "D5 F16",
    "index_code:s value_date:s windows:i movers:i leader:s",
    """SELECT v.index_code, v.value_date, 3 AS windows, (SELECT least(count(*), 5) FROM variant_windows p WHERE p.index_code = v.index_code AND p.value_date = v.value_date AND p.window_days = 30) AS movers,
    (SELECT p.stable_variant_id FROM variant_windows p WHERE p.index_code = v.index_code AND p.value_date = v.value_date AND p.window_days = 30 ORDER BY contribution DESC, stable_variant_id LIMIT 1) AS leader
    FROM daily_values v""",
    ["daily_values", "variant_windows"],
)
def nested_analytics(spark: SparkSession, sf: str) -> DataFrame:
    values, contributions, per_variant = _windows(spark, sf)
    ranked = analytics.with_names(
        analytics.rankings(per_variant, 5), views.products(spark, sf), views.definitions(spark)
    )
    nested = analytics.nested_analytics(
        analytics.daily_analytics(values, per_variant),
        analytics.window_summary(values, contributions, per_variant),
        ranked,
    )
    month = F.element_at("windows", 3)
    return nested.select(
        "index_code",
        "value_date",
        F.size("windows").alias("windows"),
        F.coalesce(F.size(month["top_movers"]), F.lit(0)).alias("movers"),
        F.get(month["contribution_leaders"], F.lit(0))["stable_variant_id"].alias("leader"),
    )


@query(
    "order_revenue_volatility",
    "W6 W5",
    "index_code:s value_date:s drawdown:f8 volatility_30d:f6 volatility_observations:i",
    """SELECT index_code, value_date, index_value / max(index_value) OVER (PARTITION BY index_code ORDER BY value_date) - 1 AS drawdown,
    stddev_samp(daily_return) OVER w * sqrt(365) AS volatility_30d, count(*) OVER w AS volatility_observations FROM history
    WINDOW w AS (PARTITION BY index_code ORDER BY value_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
    ["history"],
)
def order_revenue_volatility(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.history(spark, sf).withColumn("whole_market_carried_forward", F.lit(False))
    return analytics.drawdown_and_volatility(rows)
