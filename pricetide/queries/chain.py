"""Chain-linked index queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.prices import usable, used_price
from pricetide.operators import chain
from pricetide.queries import views
from pricetide.queries.registry import query

_VALUES = (
    "index_code:s value_date:s index_value:f4 daily_return:f8 n_constituents_active:i n_capped:i"
    " n_carried_forward:i n_stale:i whole_market_carried_forward:b rebalance_effective_date:s calc_version:s"
)


@query(
    "chain_index_values",
    "D3 A3 W4 F11 J3 J4 J5 W2 W3 ST5",
    _VALUES,
    "SELECT * FROM daily_values",
    ["daily_values"],
)
def chain_index_values(spark: SparkSession, sf: str) -> DataFrame:
    return views.chain_tables(spark, sf)[0]


@query(
    "chain_contributions",
    "D3 A3 F11",
    "index_code:s value_date:s stable_variant_id:s cm_product_id:i variant_key:s weight:f8 used_return:f8 contribution:f8 flag:s",
    "SELECT * FROM contributions",
    ["contributions"],
)
def chain_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return views.chain_tables(spark, sf)[1]


@query(
    "price_fallback",
    "P1",
    "cm_product_id:i variant_key:s value_date:s used_price:f8",
    "SELECT *, coalesce(price_avg, price_low) AS used_price FROM price_panel",
    ["price_panel"],
)
def price_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return views.price_panel(spark, sf).withColumn(
        "used_price", used_price(F.col("price_avg"), F.col("price_low"))
    )


@query(
    "usable_prices",
    "P2",
    "l_orderkey:i l_linenumber:i price:f6 usable_price:f6",
    """SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(price) THEN price END AS price,
    CASE WHEN isfinite(price) AND price > 0 THEN price END AS usable_price
    FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE
          WHEN l_linenumber = 3 THEN -l_quantity WHEN l_linenumber = 4 THEN 0 WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)""",
)
def usable_prices(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    price = (
        F.when(n == 1, float("nan"))
        .when(n == 2, float("inf"))
        .when(n == 3, -F.col("l_quantity"))
        .when(n == 4, 0.0)
        .when(n == 5, F.lit(None))
        .otherwise(F.col("l_extendedprice"))
    )
    rows = views.table(spark, sf, "lineitem").withColumn("p", price)
    finite = ~F.isnan("p") & (F.abs("p") < float("inf"))
    return rows.withColumn("usable_price", usable(F.col("p"))).withColumn("price", F.when(finite, F.col("p")))


@query(
    "rebalance_in_force",
    "J3 ST5",
    "index_code:s value_date:s effective_date:s unchanged:b",
    """SELECT s.index_code, c.value_date, s.effective_date, c.unchanged FROM archive_calendar c JOIN definitions d USING (game_key)
    JOIN basket_steps s ON s.index_code = d.index_code AND c.value_date >= s.effective_date AND (s.next_date IS NULL OR c.value_date < s.next_date)""",
    ["archive_calendar", "definitions", "basket_steps"],
)
def rebalance_in_force(spark: SparkSession, sf: str) -> DataFrame:
    return chain.index_days(
        views.archive_calendar(spark, sf), views.basket(spark, sf), views.definitions(spark)
    )


@query(
    "member_price_panel",
    "J4 J5 P1",
    "index_code:s value_date:s cm_product_id:i variant_key:s effective_date:s used_price:f8",
    "SELECT * FROM panel",
    ["panel"],
)
def member_price_panel(spark: SparkSession, sf: str) -> DataFrame:
    return chain.member_panel(
        views.price_panel(spark, sf),
        views.basket(spark, sf),
        views.archive_calendar(spark, sf),
        views.definitions(spark),
        views.METHOD,
    )


@query(
    "member_flags",
    "W2 W3 F11 ST3 ST5",
    "index_code:s value_date:s cm_product_id:i variant_key:s used_return:f8 flag:s",
    "SELECT * FROM flagged",
    ["flagged"],
)
def member_flags(spark: SparkSession, sf: str) -> DataFrame:
    return views.flagged(spark, sf)


@query(
    "whole_table_duplicate_days",
    "J5 A14",
    "game_key:s cm_product_id:i variant_key:s value_date:s price:f6",
    """SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, l_partkey AS cm_product_id,
    CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS variant_key, CAST(l_shipdate AS DATE) AS value_date,
    arg_max(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS price
    FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def whole_table_duplicate_days(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.operators.merge import PRICE_KEY, keep_last

    rows = views.table(spark, sf, "lineitem").select(
        views.part_game(F.col("l_partkey")).alias("game_key"),
        F.col("l_partkey").alias("cm_product_id"),
        views.variant_of(F.col("l_returnflag")).alias("variant_key"),
        F.to_date("l_shipdate").alias("value_date"),
        F.col("l_extendedprice").alias("price"),
        "l_orderkey",
        "l_linenumber",
    )
    return keep_last(rows, PRICE_KEY, ["l_orderkey", "l_linenumber", "price"])


@query(
    "single_selection_index",
    "D4",
    "index_code:s value_date:s index_value:f4 daily_return:f8 n_constituents_active:i n_stale:i",
    """SELECT index_code, value_date, 250.0::DOUBLE * product(1 + daily_return) OVER (PARTITION BY index_code ORDER BY value_date) AS index_value,
    daily_return, n_constituents_active, n_stale
    FROM (SELECT index_code, value_date, avg(used_return) FILTER (flag <> 'stale') AS daily_return,
          count(*) FILTER (flag <> 'stale') AS n_constituents_active, count(*) FILTER (flag = 'stale') AS n_stale
          FROM one_flagged GROUP BY 1, 2) WHERE n_constituents_active > 0""",
    ["one_flagged"],
)
def single_selection_index(spark: SparkSession, sf: str) -> DataFrame:
    prices = views.price_panel(spark, sf)
    index = views.index_of(F.col("game_key"), F.col("product_kind"))
    chosen = prices.filter(F.col("variant_key") == "nonfoil").select(
        index.alias("index_code"), "cm_product_id", "variant_key", "stable_variant_id"
    ).distinct()
    values, _ = chain.calculate_daily_values(
        prices, chosen, views.definitions(spark), views.METHOD, start_value=250.0
    )
    return values


views.SQL["one_panel"] = (
    ["price_panel", "definitions"],
    """SELECT d.index_code, c.value_date, m.cm_product_id, m.variant_key, m.stable_variant_id, false AS unchanged, f.first AS effective_date,
    coalesce(p.price_avg, p.price_low) AS used_price
    FROM (SELECT DISTINCT game_key, value_date FROM price_panel) c
    JOIN (SELECT game_key, min(value_date) AS first FROM price_panel GROUP BY 1) f USING (game_key)
    JOIN (SELECT DISTINCT game_key, product_kind, cm_product_id, variant_key, stable_variant_id FROM price_panel WHERE variant_key = 'nonfoil') m USING (game_key)
    JOIN definitions d ON d.game_key = m.game_key AND d.product_kind = m.product_kind
    LEFT JOIN price_panel p ON p.cm_product_id = m.cm_product_id AND p.variant_key = m.variant_key AND p.value_date = c.value_date""",
)
views.SQL.update(views._chain_views("one_panel", "one_"))

_RUN = date(1999, 6, 30)


@query(
    "prices_up_to_run_date",
    "S3 U1 P3",
    "cm_product_id:i variant_key:s value_date:s product_kind:s price_avg:f8 avg7:f8",
    """SELECT cm_product_id, variant_key, value_date, product_kind, price_avg, NULL AS avg7 FROM price_panel
    WHERE value_date <= DATE '1999-06-30' AND strftime(value_date, '%Y-%m') <= '1999-06'""",
    ["price_panel"],
)
def prices_up_to_run_date(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.plans.daily import merge_price_partitions
    from pricetide.sources.tables import read_prices
    from pricetide.streaming.prices import price_rows

    root = views.scratch(spark)
    merge_price_partitions(spark, root, price_rows(views.price_panel(spark, sf)))
    return read_prices(spark, root, _RUN)
