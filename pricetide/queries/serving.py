"""Index history, status and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import performance, reports
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.sources import tables

_H = "index_code:s value_date:s index_value:f2"
_BOTH = ["history", "history_definitions"]


def _hd(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return views.history(spark, sf), views.history_definitions(spark, sf)


@query(
    "post_inception_history",
    "P7",
    _H,
    "SELECT h.* FROM history h JOIN history_definitions d USING (index_code) WHERE h.value_date >= d.base_date",
    _BOTH,
)
def post_inception_history(spark: SparkSession, sf: str) -> DataFrame:
    return performance.post_inception(*_hd(spark, sf))


@query(
    "validation_row_counts",
    "P7",
    "index_code:s validation_rows:i",
    "SELECT index_code, count(*) FILTER (value_date < base_date) AS validation_rows FROM history JOIN history_definitions USING (index_code) GROUP BY 1",
    _BOTH,
)
def validation_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return performance.validation_rows(*_hd(spark, sf))


@query(
    "chart_ranges",
    "P8 D19",
    _H + " range:s",
    """SELECT h.*, r.label AS range FROM history h JOIN (SELECT index_code, max(value_date) AS latest FROM history GROUP BY 1) USING (index_code)
    CROSS JOIN (VALUES ('1M', 30), ('3M', 90), ('6M', 180), ('1Y', 365), ('Max', 100000)) r(label, days) WHERE h.value_date >= latest - r.days""",
    ["history"],
)
def chart_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return performance.chart_ranges(views.history(spark, sf))


@query(
    "published_definitions",
    "P9",
    "index_code:s name:s",
    "SELECT * FROM history_definitions WHERE status = 'published' AND history_start_kind = 'published'",
    ["history_definitions"],
)
def published_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return performance.published(views.history_definitions(spark, sf))


@query(
    "portfolio_indexes",
    "P20",
    "index_code:s status:s",
    "SELECT * FROM history_definitions WHERE status = 'published' AND index_code IN (SELECT index_code FROM history)",
    _BOTH,
)
def portfolio_indexes(spark: SparkSession, sf: str) -> DataFrame:
    history, defs = _hd(spark, sf)
    return performance.usable_for_portfolios(defs, history)


@query(
    "visible_definitions",
    "P16",
    "index_code:s status:s days:i",
    """SELECT d.index_code, d.status, count(h.value_date) AS days FROM definitions d LEFT JOIN history h USING (index_code)
    WHERE d.status IN ('published', 'accumulating') GROUP BY 1, 2""",
    ["definitions", "history"],
)
def visible_definitions(spark: SparkSession, sf: str) -> DataFrame:
    shown = tables.visible(views.definitions(spark)).select("index_code", "status")
    days = views.history(spark, sf).groupBy("index_code").agg(F.count("value_date").alias("days"))
    return shown.join(days, "index_code", "left").fillna(0, ["days"])


@query(
    "visible_members",
    "J24 P16",
    "index_code:s effective_date:s cm_product_id:i variant_key:s",
    "SELECT * FROM basket WHERE index_code IN (SELECT index_code FROM definitions WHERE status IN ('published', 'accumulating'))",
    ["basket", "definitions"],
)
def visible_members(spark: SparkSession, sf: str) -> DataFrame:
    return tables.visible_children(views.basket(spark, sf), views.definitions(spark), "index_code")


@query(
    "sparkline_rows",
    "T7",
    _H,
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY value_date DESC) AS rn FROM history) WHERE rn <= 90",
    ["history"],
)
def sparkline_rows(spark: SparkSession, sf: str) -> DataFrame:
    return performance.last_observations(views.history(spark, sf), 90)


views.SQL["chart_points"] = (
    ["history"],
    """SELECT index_code, value_date, round(index_value, 2) AS value,
    round((index_value / max(index_value) OVER (PARTITION BY index_code ORDER BY value_date) - 1) * 100, 2) AS drawdown FROM history""",
)


@query(
    "chart_points",
    "W5 D19",
    "index_code:s value_date:s value:f2 drawdown:f2",
    "SELECT * FROM chart_points",
    ["chart_points"],
)
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    return performance.chart_points(views.history(spark, sf))


@query(
    "row_changes",
    "W9 D19",
    "index_code:s d1:f8 d7:f8 d30:f8",
    """SELECT index_code, last / p1 - 1 AS d1, last / p7 - 1 AS d7, last / p30 - 1 AS d30
    FROM (SELECT index_code, max(index_value) FILTER (rn = 1) AS last, max(index_value) FILTER (rn = least(2, n)) AS p1,
          max(index_value) FILTER (rn = least(8, n)) AS p7, max(index_value) FILTER (rn = least(31, n)) AS p30
          FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY value_date DESC) AS rn, count(*) OVER (PARTITION BY index_code) AS n FROM history) GROUP BY 1)""",
    ["history"],
)
def row_changes(spark: SparkSession, sf: str) -> DataFrame:
    return performance.changes(views.history(spark, sf))


@query(
    "customer_changes",
    "W9",
    "index_code:s d1:f8 d7:f8 d30:f8",
    """SELECT index_code, last / p1 - 1 AS d1, last / p7 - 1 AS d7, last / p30 - 1 AS d30
    FROM (SELECT CAST(o_custkey AS VARCHAR) AS index_code, max(v) FILTER (rn = 1) AS last, max(v) FILTER (rn = least(2, n)) AS p1, max(v) FILTER (rn = least(8, n)) AS p7, max(v) FILTER (rn = least(31, n)) AS p30
          FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n
                FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)) GROUP BY 1)""",
)
def customer_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("index_code"), F.to_date("o_orderdate").alias("value_date")
    ).agg(F.max("o_totalprice").alias("index_value"))
    return performance.changes(rows)


views.SQL["recent_volatility"] = (
    ["history"],
    """SELECT index_code, CASE WHEN count(*) >= 2 THEN stddev_pop(daily_return) * sqrt(365) ELSE 0 END AS annualized_volatility_30d
    FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY value_date DESC) AS rn FROM history) WHERE rn <= 30 GROUP BY 1""",
)


@query(
    "recent_volatility",
    "W7",
    "index_code:s annualized_volatility_30d:f6",
    "SELECT * FROM recent_volatility",
    ["recent_volatility"],
)
def recent_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return performance.recent_volatility(views.history(spark, sf))


@query(
    "history_summary",
    "A20 D19",
    "index_code:s start_date:s end_date:s observation_count:i period_return:f8 max_drawdown:f6 best_day:s worst_day:s positive_day_ratio:f8 annualized_volatility_30d:f6 capped_days:i carried_forward_days:i",
    """SELECT d.index_code, h.start_date, h.end_date, coalesce(observation_count, 0) AS observation_count, coalesce(period_return, 0) AS period_return, coalesce(max_drawdown, 0) AS max_drawdown,
    best_day, worst_day, coalesce(positive_day_ratio, 0) AS positive_day_ratio, coalesce(v.annualized_volatility_30d, 0) AS annualized_volatility_30d, coalesce(capped_days, 0) AS capped_days, coalesce(carried_forward_days, 0) AS carried_forward_days
    FROM history_definitions d LEFT JOIN (SELECT index_code, min(value_date) AS start_date, max(value_date) AS end_date, count(*) AS observation_count,
      arg_max(index_value, value_date) / arg_min(index_value, value_date) - 1 AS period_return,
      (list(value_date ORDER BY daily_return DESC, value_date))[1] AS best_day, (list(value_date ORDER BY daily_return, value_date))[1] AS worst_day,
      avg(CASE WHEN daily_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive_day_ratio, count(*) FILTER (n_capped > 0) AS capped_days, count(*) FILTER (n_carried_forward > 0) AS carried_forward_days
      FROM history GROUP BY 1) h USING (index_code)
    LEFT JOIN recent_volatility v USING (index_code) LEFT JOIN (SELECT index_code, min(drawdown) / 100 AS max_drawdown FROM chart_points GROUP BY 1) c USING (index_code)""",
    ["history", "history_definitions", "recent_volatility", "chart_points"],
)
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return performance.summary(*_hd(spark, sf))


@query(
    "current_versions",
    "W13",
    "index_code:s value_date:s calc_version:s index_value:f2",
    """SELECT o_custkey AS index_code, CAST(o_orderdate AS DATE) AS value_date, max(v) AS calc_version, arg_max(o_totalprice, v) AS index_value
    FROM (SELECT *, o_orderpriority || '.' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS v FROM orders) GROUP BY 1, 2""",
)
def current_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("index_code"),
        F.to_date("o_orderdate").alias("value_date"),
        F.concat_ws(".", "o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("calc_version"),
        F.col("o_totalprice").alias("index_value"),
    )
    return performance.current_version(rows)


@query(
    "history_csv",
    "K6 F20",
    "index_code:s value_date:s index_value:s daily_return:s n_constituents_active:s n_capped:s n_carried_forward:s calc_version:s",
    """SELECT index_code, value_date, printf('%.6f', index_value) AS index_value, printf('%.8f', daily_return) AS daily_return, n_constituents_active, coalesce(n_capped, 0) AS n_capped,
    coalesce(n_carried_forward, 0) AS n_carried_forward, coalesce(calc_version, '') AS calc_version FROM history WHERE index_code IN (SELECT index_code FROM history_definitions WHERE status = 'published')""",
    _BOTH,
)
def history_csv(spark: SparkSession, sf: str) -> DataFrame:
    return performance.history_csv_rows(*_hd(spark, sf))


@query(
    "search_records",
    "K8",
    "id:s name:s score:f2 category:s status:s target_size:i",
    """SELECT index_code AS id, name, CASE WHEN status = 'published' THEN latest END AS score, universe AS category, status, target_size
    FROM history_definitions LEFT JOIN (SELECT index_code, arg_max(index_value, value_date) AS latest FROM history GROUP BY 1) USING (index_code)""",
    _BOTH,
)
def search_records(spark: SparkSession, sf: str) -> DataFrame:
    history, defs = _hd(spark, sf)
    return performance.search_records(defs, history)


@query(
    "public_summaries",
    "K8 P9",
    "index_code:s breadth:f8 volatility_30d:f6",
    """SELECT index_code, CASE WHEN status = 'published' AND history_start_kind = 'published' THEN breadth ELSE 0 END AS breadth,
    CASE WHEN status = 'published' AND history_start_kind = 'published' THEN annualized_volatility_30d ELSE 0 END AS volatility_30d
    FROM history_definitions LEFT JOIN (SELECT index_code, avg(CASE WHEN daily_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth FROM history GROUP BY 1) USING (index_code) LEFT JOIN recent_volatility USING (index_code)""",
    ["history", "history_definitions", "recent_volatility"],
)
def public_summaries(spark: SparkSession, sf: str) -> DataFrame:
    history, defs = _hd(spark, sf)
    breadth = history.groupBy("index_code").agg(F.avg((F.col("daily_return") > 0).cast("double")).alias("breadth"))
    metrics = breadth.join(
        performance.recent_volatility(history).withColumnRenamed("annualized_volatility_30d", "volatility_30d"), "index_code"
    )
    return performance.public_summaries(defs, metrics)


@query(
    "status_rollup",
    "A24",
    "index_code:s status:s freshness:s last_calc_date:s gap_count:i",
    """SELECT index_code, status, freshness, (SELECT max(value_date) FROM history) AS last_calc_date, (SELECT count(*) FROM days WHERE run_date NOT IN (SELECT value_date FROM history)) AS gap_count
    FROM history_definitions LEFT JOIN (SELECT index_code, max(value_date) AS freshness FROM history GROUP BY 1) USING (index_code)""",
    ["history", "history_definitions", "days"],
)
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import date

    from pricetide.operators import archive

    history, defs = _hd(spark, sf)
    days = archive.calendar_days(spark.range(1), F.lit(date(1995, 1, 1)), F.lit(date(2001, 12, 31)))
    gaps = archive.missing_days(days, history.withColumnRenamed("value_date", "run_date"))
    return performance.status_rollup(defs, history, gaps)


@query(
    "index_pages",
    "J25",
    "index_code:s name:s observations:i first_day:s last_value:f2",
    """SELECT index_code, name, coalesce(n, 0) AS observations, first_day, last_value FROM history_definitions
    LEFT JOIN (SELECT index_code, count(*) AS n, min(value_date) AS first_day, arg_max(index_value, value_date) AS last_value FROM history GROUP BY 1) USING (index_code)""",
    _BOTH,
)
def index_pages(spark: SparkSession, sf: str) -> DataFrame:
    history, defs = _hd(spark, sf)
    return performance.with_history(defs, history).select(
        "index_code",
        "name",
        F.coalesce(F.size("history"), F.lit(0)).alias("observations"),
        F.get("history", F.lit(0))["value_date"].alias("first_day"),
        F.try_element_at("history", F.lit(-1))["index_value"].alias("last_value"),
    )


@query(
    "weekly_chart_rows",
    "P19 F8",
    _H,
    "SELECT * FROM history WHERE strftime(value_date, '%G-W%V') = '1998-W53'",
    ["history"],
)
def weekly_chart_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.week_rows(views.history(spark, sf), "1998-W53")


views.SQL["highlights"] = (
    ["history", "history_definitions"],
    """SELECT w.*, name, coalesce(before_value, first_value) AS start_value, end_value / coalesce(before_value, first_value) - 1 AS raw FROM (
      SELECT index_code, week, arg_min(index_value, value_date) AS first_value, arg_max(index_value, value_date) AS end_value, arg_min(before, value_date) FILTER (before IS NOT NULL AND rn = 1) AS before_value,
        count(*) AS observations, count(*) FILTER (n_capped > 0) AS capped_days, count(*) FILTER (n_carried_forward > 0) AS carried_days
      FROM (SELECT *, row_number() OVER (PARTITION BY index_code, week ORDER BY value_date) AS rn FROM
            (SELECT *, strftime(value_date, '%G-W%V') AS week, lag(index_value) OVER (PARTITION BY index_code ORDER BY value_date) AS before FROM history)) GROUP BY 1, 2) w
    JOIN history_definitions USING (index_code)""",
)


@query(
    "weekly_highlights",
    "A22 W10 D20 F13",
    "index_code:s week:s headline:s weekly_return:f8 start_value:f2 end_value:f2 observations:i events:s",
    """SELECT *, raw AS weekly_return, name || CASE WHEN raw >= 0 THEN ' rose ' ELSE ' fell ' END || printf('%.2f', abs(raw * 100)) || '%' AS headline,
    CASE WHEN capped_days = 0 AND carried_days = 0 THEN 'No calculation flags were recorded during the week.'
      ELSE concat_ws('|', CASE WHEN capped_days > 0 THEN capped_days || ' day(s) included capped constituents.' END, CASE WHEN carried_days > 0 THEN carried_days || ' day(s) used at least one carried-forward value.' END) END AS events FROM highlights""",
    ["highlights"],
)
def weekly_highlights(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.weekly_highlights(*_hd(spark, sf))
    return rows.withColumn("events", F.array_join("notable_events", "|"))


@query(
    "weekly_reports",
    "A23 T8 D20",
    "week:s id:s status:s highlights:i first_code:s place:i",
    """SELECT week, week || '-generated' AS id, 'draft' AS status, count(*) AS highlights, min(index_code) AS first_code, row_number() OVER (ORDER BY week DESC) AS place FROM highlights GROUP BY 1""",
    ["highlights"],
)
def weekly_reports(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    drafts = reports.weekly_reports(reports.weekly_highlights(*_hd(spark, sf)))
    # One row per calendar week, newest first.
    newest = Window.orderBy(F.desc("week"))
    return drafts.select(
        "week",
        "id",
        "status",
        F.size("highlights").alias("highlights"),
        F.get("highlights", F.lit(0))["index_code"].alias("first_code"),
        F.row_number().over(newest).alias("place"),
    )


def _stored_reports(spark: SparkSession, sf: str) -> DataFrame:
    weeks = reports.weekly_reports(reports.weekly_highlights(*_hd(spark, sf))).select("week", "id", "status")
    number = F.substring("week", 7, 2).cast("int")
    return weeks.filter(number <= 20).withColumn("id", F.concat("week", F.lit("-old"))).withColumn(
        "status", F.when(number <= 5, "published").otherwise("draft")
    )


@query(
    "replaced_reports",
    "U7 P18",
    "week:s id:s status:s",
    """SELECT week, CASE WHEN CAST(right(week, 2) AS INT) <= 5 THEN week || '-old' ELSE week || '-generated' END AS id, CASE WHEN CAST(right(week, 2) AS INT) <= 5 THEN 'published' ELSE 'draft' END AS status
    FROM (SELECT DISTINCT week FROM highlights)""",
    ["highlights"],
)
def replaced_reports(spark: SparkSession, sf: str) -> DataFrame:
    drafts = reports.weekly_reports(reports.weekly_highlights(*_hd(spark, sf))).select("week", "id", "status")
    redo = drafts.filter(F.substring("week", 7, 2).cast("int") > 5)
    return reports.replace_reports(_stored_reports(spark, sf), redo)


@query(
    "regeneration_conflicts",
    "P18",
    "week:s id:s",
    "SELECT DISTINCT week, week || '-old' AS id FROM highlights WHERE CAST(right(week, 2) AS INT) <= 5",
    ["highlights"],
)
def regeneration_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    drafts = reports.weekly_reports(reports.weekly_highlights(*_hd(spark, sf)))
    return reports.regeneration_conflicts(_stored_reports(spark, sf), drafts)


@query(
    "highlight_mismatches",
    "J27",
    "week:s index_code:s problem:s",
    """SELECT w.week, d.index_code, 'missing' AS problem FROM (SELECT DISTINCT week FROM highlights) w CROSS JOIN history_definitions d
    WHERE NOT EXISTS (SELECT 1 FROM highlights h WHERE h.week = w.week AND h.index_code = d.index_code)""",
    ["highlights", "history_definitions"],
)
def highlight_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    history, defs = _hd(spark, sf)
    return reports.highlight_mismatch(reports.weekly_highlights(history, defs), defs)
