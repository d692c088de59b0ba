"""Holdings and portfolio comparison queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import portfolio
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.sources.holdings import parse_holdings

_BASIS = date(1999, 2, 1)

views.SQL.update(
    {
        "lookup": (
            ["intervals"],
            """SELECT cm_product_id, variant_key, (max(struct_pack(d := member_since, i := index_code, p := ref_price))).p * 1.000123457::DOUBLE AS ref_price FROM intervals GROUP BY 1, 2""",
        ),
        "marked": (
            ["holdings"],
            """SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN row_number() OVER (PARTITION BY portfolio_id, cm_product_id, variant_key, error IS NULL ORDER BY line) > 1 THEN 'Duplicate product and variant' END AS problem FROM holdings""",
        ),
        "validated": (
            ["marked", "lookup"],
            """SELECT portfolio_id, line, m.cm_product_id, m.variant_key, quantity, coalesce(problem, CASE WHEN l.ref_price IS NULL THEN 'Unmatched Cardmarket product ' || m.cm_product_id || ' (' || m.variant_key || ')' END) AS error,
            CASE WHEN problem IS NULL THEN round(l.ref_price * quantity, 2) END AS market_value_eur, CASE WHEN problem IS NULL AND l.ref_price IS NOT NULL THEN round(cost_basis_eur * quantity, 2) END AS cost_basis_value_eur
            FROM marked m LEFT JOIN lookup l ON l.cm_product_id = m.cm_product_id AND l.variant_key = m.variant_key""",
        ),
        "benchmark_rows": (
            ["history"],
            f"""SELECT * FROM (SELECT *, count(*) FILTER (value_date >= DATE '{_BASIS}') OVER (PARTITION BY index_code) AS hits FROM history) WHERE hits = 0 OR value_date >= DATE '{_BASIS}'""",
        ),
        "portfolio_summary": (
            ["validated", "benchmark_rows"],
            """SELECT *, round((portfolio_return - benchmark_return) * 100, 2) AS relative_pp FROM (
              SELECT portfolio_id, index_code, first_date, last_date, round(market, 2) AS latest_market_value, CASE WHEN has_cost THEN round(cost, 2) END AS provided_cost_basis,
                CASE WHEN has_cost AND cost > 0 THEN market / cost - 1 END AS portfolio_return, last_value / first_value - 1 AS benchmark_return
              FROM (SELECT portfolio_id, sum(market_value_eur) AS market, sum(coalesce(cost_basis_value_eur, 0)) AS cost, bool_or(cost_basis_value_eur IS NOT NULL) AS has_cost FROM validated WHERE error IS NULL GROUP BY 1)
              JOIN (SELECT o_orderkey AS portfolio_id, o_orderpriority AS index_code FROM orders) USING (portfolio_id)
              JOIN (SELECT index_code, min(value_date) AS first_date, max(value_date) AS last_date, arg_min(index_value, value_date) AS first_value, arg_max(index_value, value_date) AS last_value FROM benchmark_rows GROUP BY 1) USING (index_code))""",
        ),
    }
)


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.intervals(spark, sf).withColumn("ref_price", F.col("ref_price") * 1.000123457)
    lookup = portfolio.constituent_lookup(rows, ["member_since", "index_code"])
    return portfolio.validate(views.holdings(spark, sf), lookup)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    # Every order is measured against the index of its own priority.
    choices = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("portfolio_id"), F.col("o_orderpriority").alias("index_code")
    )
    return portfolio.summarize(_validated(spark, sf), views.history(spark, sf), choices, F.lit(_BASIS))


@query(
    "holdings_csv",
    "S7 F19",
    "portfolio_id:s line:i error:s cm_product_id:i variant_key:s quantity:f4 cost_basis_eur:f2",
    f"""WITH docs AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || CAST(l_shipdate AS DATE) AS portfolio_id, {views.BRAND} AS pid,
      CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS v, l_tax, l_quantity, l_suppkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN l_extendedprice END AS cost FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT portfolio_id, 1 AS line, 'Missing required column: quantity' AS error, NULL AS cm_product_id, 'nonfoil' AS variant_key, NULL AS quantity, NULL AS cost_basis_eur FROM docs WHERE l_linenumber = 7
    UNION ALL SELECT portfolio_id, n, CASE WHEN l_tax = 0 THEN 'Invalid quantity' END, pid, v, CASE WHEN l_tax <> 0 THEN l_quantity END, cost FROM docs, (VALUES (2), (3)) t(n) WHERE l_linenumber <> 7
    UNION ALL SELECT portfolio_id, 4, 'Invalid cm_product_id', NULL, 'foil', 1, NULL FROM docs WHERE l_linenumber <> 7
    UNION ALL SELECT portfolio_id, 5, CASE WHEN l_suppkey = 0 THEN 'Invalid cm_product_id' END, CASE WHEN l_suppkey > 0 THEN l_suppkey END, 'foil', 2.5, NULL FROM docs WHERE l_linenumber <> 7""",
)
def holdings_csv(spark: SparkSession, sf: str) -> DataFrame:
    return parse_holdings(views.holdings_documents(spark, sf))


@query(
    "duplicate_holdings",
    "W17",
    "portfolio_id:i line:i cm_product_id:i variant_key:s problem:s",
    "SELECT * FROM marked",
    ["marked"],
)
def duplicate_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.mark_duplicates(views.holdings(spark, sf)).withColumnRenamed("error", "problem")


@query(
    "constituent_lookup",
    "U6 J18",
    "cm_product_id:i variant_key:s ref_price:f6",
    "SELECT * FROM lookup",
    ["lookup"],
)
def constituent_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.intervals(spark, sf).withColumn("ref_price", F.col("ref_price") * 1.000123457)
    return portfolio.constituent_lookup(rows, ["member_since", "index_code"])


@query(
    "validated_holdings",
    "J18 D17 F20",
    "portfolio_id:i line:i error:s cm_product_id:i variant_key:s quantity:f2 market_value_eur:f2 cost_basis_value_eur:f2",
    "SELECT * FROM validated",
    ["validated"],
)
def validated_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf)


@query(
    "portfolio_summaries",
    "A21 D17 P15",
    "portfolio_id:i index_code:s latest_market_value:f2 provided_cost_basis:f2 portfolio_return:f8 benchmark_return:f8 relative_pp:f2",
    "SELECT * FROM portfolio_summary",
    ["portfolio_summary"],
)
def portfolio_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf)


@query(
    "portfolio_comparison",
    "W12 D17",
    "portfolio_id:i index_code:s point:i value_date:s portfolio:f2 benchmark:f2 relative_pct:f2",
    """SELECT portfolio_id, index_code, 0 AS point, first_date AS value_date, 1000 AS portfolio, 1000 AS benchmark, 0 AS relative_pct FROM portfolio_summary WHERE portfolio_return IS NOT NULL
    UNION ALL SELECT portfolio_id, index_code, 1, last_date, round(1000 * (1 + portfolio_return), 2), round(1000 * (1 + benchmark_return), 2), round(((1 + portfolio_return) / (1 + benchmark_return) - 1) * 100, 2) FROM portfolio_summary WHERE portfolio_return IS NOT NULL""",
    ["portfolio_summary"],
)
def portfolio_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.comparison(_summary(spark, sf))


@query(
    "benchmark_window",
    "P15",
    "index_code:s value_date:s index_value:f2",
    "SELECT * FROM benchmark_rows",
    ["benchmark_rows"],
)
def benchmark_window(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.benchmark_window(views.history(spark, sf), F.lit(_BASIS))


@query(
    "benchmark_series",
    "W11 D17",
    "index_code:s value_date:s benchmark:f2",
    "SELECT index_code, value_date, round(index_value / first_value(index_value) OVER (PARTITION BY index_code ORDER BY value_date) * 1000, 2) AS benchmark FROM benchmark_rows",
    ["benchmark_rows"],
)
def benchmark_series(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.benchmark_series(views.history(spark, sf), F.lit(_BASIS))
