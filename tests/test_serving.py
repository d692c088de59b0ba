from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricetide.functions import dates, ids, text
from pricetide.operators import performance, portfolio, reports
from pricetide.schemas import HISTORY
from pricetide.sources.holdings import UPLOAD_BYTES, UPLOAD_ROWS, parse_holdings, read_holdings
from tests.conftest import rows


def history(spark, points, code="X"):
    return spark.createDataFrame(
        [(code, d, float(v), float(r), 1, c, f, "1") for d, v, r, c, f in points], HISTORY
    )


def three_days(spark):
    return history(
        spark,
        [
            (date(2025, 7, 1), 1000, 0.0, 0, 0),
            (date(2026, 6, 15), 1200, 0.2, 1, 0),
            (date(2026, 7, 15), 900, -0.25, 0, 2),
        ],
    )


def test_summary(spark):
    defs = spark.createDataFrame([("X",), ("EMPTY",)], "index_code string")
    got = {r.index_code: r for r in performance.summary(three_days(spark), defs).collect()}
    x = got["X"]
    assert (x.period_return, x.max_drawdown) == (pytest.approx(-0.1), pytest.approx(-0.25))
    assert (x.best_day, x.worst_day) == (date(2026, 6, 15), date(2026, 7, 15))
    assert x.positive_day_ratio == pytest.approx(1 / 3)
    assert (x.capped_days, x.carried_forward_days) == (1, 1)
    empty = got["EMPTY"]
    assert (empty.start_date, empty.observation_count, empty.period_return, empty.max_drawdown) == (None, 0, 0.0, 0.0)


def test_first_of_equal_days_is_best(spark):
    data = history(spark, [(date(2026, 1, d), 1, 0.1, 0, 0) for d in (1, 2, 3)])
    defs = spark.createDataFrame([("X",)], "index_code string")
    r = performance.summary(data, defs).first()
    assert r.best_day == r.worst_day == date(2026, 1, 1)


def test_ranges_and_changes(spark):
    data = three_days(spark)
    assert performance.chart_range(data, "1M").count() == 2
    assert performance.chart_range(data, "Max").count() == 3
    r = performance.changes(data).first()
    assert (r.d1, r.d7) == (pytest.approx(-0.25), pytest.approx(-0.1))
    one = history(spark, [(date(2026, 1, 1), 5, 0.0, 0, 0)])
    assert performance.changes(one).first().d30 == 0.0
    assert performance.recent_volatility(one).first().annualized_volatility_30d == 0.0


def test_inception(spark):
    points = [(date(2026, 7, 19), 500, 0.0, 0, 0), (date(2026, 7, 20), 1000, 0.0, 0, 0), (date(2026, 7, 21), 1100, 0.1, 0, 0)]
    defs = spark.createDataFrame([("X", date(2026, 7, 20))], "index_code string, base_date date")
    kept = performance.post_inception(history(spark, points), defs)
    assert kept.count() == 2
    assert performance.changes(kept).first().d30 == pytest.approx(0.1)
    assert performance.validation_rows(history(spark, points), defs).first().validation_rows == 1


def test_weekly_highlight(spark):
    data = history(
        spark,
        [(date(2026, 8, 2), 1000, 0.0, 0, 0), (date(2026, 8, 3), 1010, 0.01, 1, 0), (date(2026, 8, 9), 1050, 0.04, 0, 1)],
    )
    defs = spark.createDataFrame([("X", "Test")], "index_code string, name string")
    rows_ = reports.weekly_highlights(data, defs)
    r = rows_.filter("week = '2026-W32'").first()
    assert (r.weekly_return, r.observations, len(r.notable_events)) == (pytest.approx(0.05), 2, 2)
    assert r.headline == "Test rose 5.00%"
    assert reports.week_rows(data, "2026-W32").count() == 2
    assert reports.week_rows(data, "2026-W40").count() == 0
    drafts = reports.weekly_reports(rows_).select("week", "status")
    done = spark.createDataFrame([("2026-W32", "published")], "week string, status string")
    assert rows(reports.regeneration_conflicts(done, drafts), "week") == [("2026-W32",)]
    with pytest.raises(Exception, match="already published"):
        reports.replace_reports(done, drafts).collect()
    old = spark.createDataFrame([("2026-W32", "old"), ("2026-W01", "old")], "week string, status string")
    assert rows(reports.replace_reports(old, drafts), "week", "status") == [
        ("2026-W01", "old"),
        ("2026-W31", "draft"),
        ("2026-W32", "draft"),
    ]


def test_week_labels(spark):
    days = spark.createDataFrame([(date(2027, 1, 1),), (date(2026, 12, 31),), (date(2024, 12, 30),)], "d date")
    label = dates.iso_week(F.col("d"))
    assert rows(days.select(label.alias("w")), "w") == [("2025-W01",), ("2026-W53",), ("2026-W53",)]
    bounds = days.limit(1).select(
        dates.iso_week_start(F.lit("2026-W31")).alias("a"), dates.iso_week_end(F.lit("2026-W31")).alias("b"),
        dates.iso_week_start(F.lit("2026-W00")).alias("c"), dates.iso_week_start(F.lit("week")).alias("d"),
    )
    assert tuple(bounds.first()) == (date(2026, 7, 27), date(2026, 8, 2), None, None)


def test_freshness(spark):
    data = spark.createDataFrame([("2026-08-09",), ("2026-08-04",), ("2026-07-29",), (None,), ("2026-08-10",), ("x",)], "d string")
    today = F.lit(date(2026, 8, 9))
    got = data.select(dates.freshness_level(F.col("d"), today), dates.freshness_age(F.col("d"), today), dates.freshness_label(F.col("d"), today))
    assert [tuple(r) for r in got.collect()] == [
        ("fresh", 0, "Current today"),
        ("delayed", 5, "5 days old"),
        ("stale", 11, "11 days old"),
        ("unknown", None, "Freshness unknown"),
        ("unknown", None, "Future-dated snapshot"),
        ("unknown", None, "Freshness unknown"),
    ]


def portfolio_case(spark):
    docs = spark.createDataFrame([(1, "cm_product_id,variant_key,quantity,cost_basis_eur\n7,,2,8\n7,nonfoil,1,\n9,foil,1,\nx,,1,\n\n7,,0,\n")], "portfolio_id bigint, csv string")
    lookup = spark.createDataFrame([(7, "nonfoil", 10.0)], "cm_product_id bigint, variant_key string, ref_price double")
    return portfolio.validate(parse_holdings(docs), lookup)


def test_portfolio(spark):
    validated = portfolio_case(spark)
    assert rows(validated, "line", "error") == [
        (2, None),
        (3, "Duplicate product and variant"),
        (4, "Unmatched Cardmarket product 9 (foil)"),
        (5, "Invalid cm_product_id"),
        (6, "Invalid quantity"),
    ]
    bench = history(spark, [(date(2026, 1, 1), 900, 0, 0, 0), (date(2026, 2, 1), 1000, 0, 0, 0), (date(2026, 3, 1), 1100, 0, 0, 0)])
    choices = spark.createDataFrame([(1, "X")], "portfolio_id bigint, index_code string")
    summary = portfolio.summarize(validated, bench, choices, F.lit(date(2026, 2, 1)))
    r = summary.first()
    assert (r.latest_market_value, r.portfolio_return, r.relative_pp) == (20.0, 0.25, 15.0)
    assert r.benchmark_return == pytest.approx(0.1)
    points = portfolio.comparison(summary).orderBy("point").collect()
    assert [(p.portfolio, p.benchmark) for p in points] == [(1000.0, 1000.0), (1250.0, 1100.0)]
    series = portfolio.benchmark_series(bench, F.lit(date(2030, 1, 1))).orderBy("value_date")
    assert [p.benchmark for p in series.collect()] == [1000.0, 1111.11, 1222.22]


def test_holdings_limits(spark):
    header = "cm_product_id,variant_key,quantity\n"
    docs = spark.createDataFrame(
        [(1, "   "), (2, "cm_product_id,cost\n1,2"), (3, header + "1,foil,1\n" * 5001), (4, header + "1,foil," + "1" * 1_000_001), (5, header + "1,foil,1")],
        "portfolio_id bigint, csv string",
    )
    limits = {"max_bytes": UPLOAD_BYTES, "max_rows": UPLOAD_ROWS}
    assert rows(parse_holdings(docs, **limits).fillna({"error": ""}), "portfolio_id", "line", "error") == [
        (1, 1, "CSV is empty"),
        (2, 1, "Missing required column: quantity"),
        (3, 1, "CSV exceeds the 5000 holding limit"),
        (4, 1, "CSV exceeds the 1 MB limit"),
        (5, 2, ""),
    ]
    unbounded = parse_holdings(docs).filter("portfolio_id IN (3, 4)")
    assert {r["portfolio_id"]: r["n"] for r in unbounded.groupBy("portfolio_id").agg(F.count("*").alias("n")).collect()} == {3: 5001, 4: 1}
    assert unbounded.filter("line = 1").count() == 0


def test_strip_is_linear(spark):
    inner = "a" + " " * 1_000_000 + "b"
    frame = spark.createDataFrame([(f"\t\x1c {inner}\x85\u3000",), ("   ",), (None,)], "t string")
    assert [r[0] for r in frame.select(text.strip(F.col("t"))).collect()] == [inner, "", None]


def test_text_helpers(spark):
    one = spark.range(1)
    got = one.select(
        text.split_list(F.lit(" a, ,b,")),
        text.inception_map(F.lit("magic=2026-07-20, pokemon = 2026-08-12,bad=x")),
        ids.conflict_key(F.lit("a/b.json.gz"), F.lit(2)),
        text.source_date(F.lit(" 0000-00-00 00:00:00")),
    ).first()
    assert got[0] == ["a", "b"]
    assert got[1] == {"magic": date(2026, 7, 20), "pokemon": date(2026, 8, 12)}
    assert got[2] == "a/b.conflict-2.json.gz"
    assert got[3] is None


def test_a_folder_of_holdings_is_listed_without_a_task_for_each_file(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"p{i}.csv").write_text(f"cm_product_id,quantity\n{i + 1},2")
    (tmp_path / "other.txt").write_text("no holdings")
    spark.sparkContext.setJobGroup("holdings listing", "")
    try:
        documents = read_holdings(spark, str(tmp_path), "*.csv")
        # Above 32 paths Spark lists them in a job; it did for a path with a pattern.
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("holdings listing")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = parse_holdings(documents)
    assert sorted(r["cm_product_id"] for r in found.collect()) == list(range(1, 41))
