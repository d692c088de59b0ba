from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricetide.functions.dates import month_starts_seen_from
from pricetide.operators import liquidity
from pricetide.plans.summaries import refresh_summaries, stored_scores
from pricetide.schemas import struct
from pricetide.sinks.versions import VersionedTable

SHAPE = struct(
    "game_key string, product_kind string, stable_variant_id string, cm_product_id bigint, variant_key string,"
    " value_date date, price_avg double, price_low double, avg30 double, month string"
)
NAMES = [
    "index_code", "effective_date", "stable_variant_id", "primary_observation_days", "price_floor_days",
    "suspect_zero_days", "price_update_days", "history_days", "first_observation_date", "last_observation_date",
    "source_avg30", "avg30", "inverse_dispersion", "mean_used_price", "liquidity_score",
]


def definitions(spark, floors=(1.0, 5.0)):
    data = [(f"I{i}", "onepiece", "single", float(f), date(2024, 3, 1) if i else date(2020, 1, 1)) for i, f in enumerate(floors)]
    return spark.createDataFrame(data, "index_code string, game_key string, product_kind string, min_price double, base_date date")


def panel(spark, seed=1, start=date(2023, 11, 20), days=200):
    rng = random.Random(seed)
    data = []
    for pid in range(6):
        price = rng.choice([1.0, 4.0, 9.0])
        for i in range(days):
            if rng.random() < (0.1, 0.5, 0.97)[pid % 3]:
                continue
            price = rng.choice([price, price, 0.0, price + 1])
            day = start + timedelta(days=i)
            data.append(("onepiece", "single", f"v{pid}", pid, "nonfoil", day, rng.choice([None, price, price]),
                         rng.choice([None, price * 0.75]), rng.choice([None, price]), f"{day:%Y-%m}"))
    return spark.createDataFrame(data, SHAPE)


def scored(df):
    found = df.select(*NAMES).collect()
    return sorted([tuple(r) for r in found], key=lambda r: r[:3])


def assert_same(got, want):
    assert want and len(got) == len(want)
    for one, two in zip(got, want, strict=True):
        assert one[:12] == two[:12]
        assert one[12:] == pytest.approx(two[12:])


@pytest.mark.parametrize("lookback", [4, 30, 60, 91])
def test_windows_are_whole_segments(spark, lookback):
    days = spark.range(800).select(F.date_add(F.lit(date(2023, 1, 1)), F.col("id").cast("int")).alias("day"))
    start = liquidity.segment_start(F.col("day"), lookback)
    seen = F.array_join(month_starts_seen_from(F.col("day"), lookback).cast("array<string>"), ",")
    found = days.select(start.alias("segment"), "day", seen.alias("seen")).groupBy("segment").agg(
        F.count_distinct("seen").alias("kinds"), F.count_distinct(F.trunc("day", "MM")).alias("months")
    )
    assert found.where("kinds > 1 OR months > 1").count() == 0


@pytest.mark.parametrize("lookback", [4, 30, 60, 91])
def test_summaries_give_the_scores_of_the_rows(spark, lookback):
    prices, defs = panel(spark, lookback), definitions(spark)
    summaries = liquidity.segment_summaries(prices, defs, lookback)
    got = liquidity.score_summaries(summaries, defs, lookback)
    assert_same(scored(got), scored(liquidity.score_liquidity(prices, defs, lookback)))


def test_only_new_and_changed_months_are_read(spark, tmp_path, monkeypatch):
    prices = VersionedTable(spark, str(tmp_path / "prices"), SHAPE, ["game_key", "month"], ["value_date"])
    defs, path = definitions(spark), str(tmp_path / "summaries")
    empty = refresh_summaries(spark, path, prices, defs, 60)
    assert stored_scores(empty, defs, 60).count() == 0
    rows = panel(spark)
    prices.replace(rows.where("month < '2024-05'"))
    read = []
    whole = VersionedTable.read_partitions
    monkeypatch.setattr(
        VersionedTable, "read_partitions", lambda self, wanted: read.append(sorted(w["month"] for w in wanted)) or whole(self, wanted)
    )
    refresh_summaries(spark, path, prices, defs, 60)
    assert read.pop() == ["2023-11", "2023-12", "2024-01", "2024-02", "2024-03", "2024-04"]
    prices.replace_partitions(rows.where("month >= '2024-05'"))
    changed = rows.where("month = '2024-01'").withColumn("price_avg", F.col("price_avg") + 1)
    prices.replace_partitions(changed)
    prices.replace_partitions(rows.limit(0), emptied=[{"game_key": "onepiece", "month": "2023-12"}])
    table = refresh_summaries(spark, path, prices, defs, 60)
    assert read == [["2024-01", "2024-05", "2024-06"]]
    assert_same(scored(stored_scores(table, defs, 60)), scored(liquidity.score_liquidity(prices.read(), defs, 60)))
    # Nothing new: nothing is read, no version is made.
    versions = table.versions()
    assert refresh_summaries(spark, path, prices, defs, 60).versions() == versions and len(read) == 1
    # Another price floor concerns every month.
    other = definitions(spark, (2.0,))
    table = refresh_summaries(spark, path, prices, other, 60)
    assert len(read[-1]) == 7
    assert_same(scored(stored_scores(table, other, 60)), scored(liquidity.score_liquidity(prices.read(), other, 60)))


def test_scores_since_a_day_read_their_windows_only(spark, tmp_path):
    prices = VersionedTable(spark, str(tmp_path / "prices"), SHAPE, ["game_key", "month"], ["value_date"])
    prices.replace(panel(spark))
    defs = definitions(spark)
    table = refresh_summaries(spark, str(tmp_path / "summaries"), prices, defs, 60)
    since = date(2024, 5, 1)
    recent = stored_scores(table, defs, 60, since)
    whole = stored_scores(table, defs, 60).where(F.col("effective_date") >= F.lit(since))
    assert_same(scored(recent), scored(whole))
    files = " ".join(recent.inputFiles())
    assert "month=2024-03" in files and "month=2024-01" not in files
