from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricetide.operators import liquidity, ranking, selection
from pricetide.params import IndexDefinition, definitions_frame
from tests.conftest import rows

PRICE = (
    "stable_variant_id string, game_key string, cm_product_id bigint, product_kind string, value_date date,"
    " variant_key string, price_low double, price_avg double, avg30 double"
)
DAY = date(2026, 8, 1)


def panel(spark, series):
    data = []
    for pid, values in series.items():
        for i, avg in enumerate(values):
            data.append(
                (f"cardmarket:onepiece:product:{pid}:nonfoil", "onepiece", pid, "single",
                 DAY - timedelta(days=len(values) - i), "nonfoil", avg - 0.5, float(avg), float(avg))
            )
    return spark.createDataFrame(data, PRICE)


def catalogue(spark, pids, added="2020-01-01"):
    return spark.createDataFrame(
        [("onepiece", p, added, date(2020, 1, 1)) for p in pids],
        "game_key string, cm_product_id bigint, source_date_added string, first_seen date",
    )


@pytest.fixture
def four_days(one_index):
    return replace(
        one_index,
        selection_lookback_days=4,
        min_history_days=4,
        min_observation_ratio=1.0,
        price_floor_observation_ratio=1.0,
        indexes=(IndexDefinition("TEST2", "Two", "onepiece", "singles", 2, date(2026, 1, 1)),),
    )


@pytest.fixture
def three_products(spark):
    return panel(spark, {1: [10.0, 11, 12, 13], 2: [9.0] * 4, 3: [1.0] * 4})


def test_selection_golden(spark, four_days, three_products):
    defs = definitions_frame(spark, four_days)
    members, removed, summary = selection.select_constituents(
        three_products, catalogue(spark, [1, 2, 3]), defs, four_days, DAY
    )
    assert rows(members, "place", "cm_product_id", "action") == [(1, 1, "added"), (2, 2, "added")]
    assert removed.count() == 0
    assert rows(summary, "index_code", "eligible_count") == [("TEST2", 2)]


def test_incumbents_are_buffered_and_failing_ones_removed(spark, four_days, three_products):
    held = spark.createDataFrame(
        [("TEST2", 1, "nonfoil"), ("TEST2", 3, "nonfoil")],
        "index_code string, cm_product_id bigint, variant_key string",
    )
    members, removed, _ = selection.select_constituents(
        three_products, catalogue(spark, [1, 2, 3]), definitions_frame(spark, four_days), four_days, DAY, held
    )
    assert rows(members, "cm_product_id", "action") == [(1, "retained"), (2, "added")]
    assert rows(removed, "cm_product_id", "reason") == [
        (3, "incumbent removed after failing current eligibility gates")
    ]


def test_liquidity_of_one_variant(spark, four_days):
    scores = liquidity.score_liquidity(
        panel(spark, {1: [10.0, 11, 12, 13]}), definitions_frame(spark, four_days), 4, [DAY]
    )
    r = scores.first()
    assert (r.primary_observation_days, r.price_update_days, r.history_days) == (4, 3, 4)
    dispersion = sum(1 - 0.5 / p for p in (10, 11, 12, 13)) / 4
    assert r.liquidity_score == pytest.approx(0.5 + 0.3 + 0.2 * dispersion)
    assert r.avg30 == 13.0


def test_changes_restart_inside_each_window(spark, four_days):
    # The step from 9 to 10 lies on the window edge: its earlier row is outside.
    scores = liquidity.score_liquidity(
        panel(spark, {1: [9.0, 10, 10, 10, 10]}), definitions_frame(spark, four_days), 4, [DAY]
    )
    assert rows(scores, "history_days", "price_update_days") == [(4, 0)]


def test_zero_prices_count_as_history_and_suspect(spark, four_days):
    scores = liquidity.score_liquidity(
        panel(spark, {1: [0.0, 0.0, 5.0, 5.0]}), definitions_frame(spark, four_days), 4, [DAY]
    )
    r = scores.first()
    assert (r.history_days, r.suspect_zero_days, r.primary_observation_days) == (4, 2, 2)


def test_seasoning_uses_source_date_then_first_seen(spark):
    products = spark.createDataFrame(
        [
            ("g", 1, "2026-01-05 10:00:00", date(2026, 2, 1)),
            ("g", 2, "", date(2026, 2, 1)),
            ("g", 3, None, date(2026, 2, 1)),
            ("g", 4, "0000-00-00", date(2026, 2, 1)),
        ],
        "game_key string, cm_product_id bigint, source_date_added string, first_seen date",
    )
    assert rows(selection.catalogue_dates(products), "cm_product_id", "added_on") == [
        (1, date(2026, 1, 5)),
        (2, date(2026, 2, 1)),
        (3, date(2026, 2, 1)),
    ]


def greedy_pick(ranked, incumbents, target, retention, entry):
    """Preferred ranks first, then the best others, written as a loop."""
    chosen = [
        key for rank, key in ranked if (rank <= retention if key in incumbents else rank <= entry)
    ][:target]
    for _, key in ranked:
        if len(chosen) >= target:
            break
        if key not in chosen:
            chosen.append(key)
    return chosen


@pytest.mark.parametrize("seed", range(5))
def test_fold_matches_a_greedy_loop(seed):
    rng = random.Random(seed)
    target, retention, entry = 5, 6, 4
    months, data, want = [], [], []
    held: list = []
    for m in range(8):
        size = rng.choice([3, 6, 9, 12])
        pids = rng.sample(range(20), size)
        ranked = [(i + 1, (p, "nonfoil")) for i, p in enumerate(pids)]
        month = date(2026, 1 + m, 1)
        months.append(month)
        for rank, (pid, variant) in ranked:
            if rank <= max(target, retention):
                data.append(("X", month, pid, variant, rank, target, retention, entry))
        if size >= target:
            held = greedy_pick(ranked, set(held), target, retention, entry)
            want += [(month, p) for p, _ in held]
    pool = pd.DataFrame(
        data,
        columns=["index_code", "effective_date", "cm_product_id", "variant_key", "rank",
                 "target_size", "retention_cutoff", "entry_cutoff"],
    )
    got = selection.incumbent_fold()(pool.sample(frac=1, random_state=seed))
    assert list(zip(got["effective_date"], got["cm_product_id"])) == want


def test_months_without_enough_candidates_are_skipped(spark, four_days):
    products = catalogue(spark, [1, 2])
    data = panel(spark, {1: [10.0, 11, 12, 13], 2: [9.0] * 4}).unionByName(
        panel(spark, {1: [10.0, 11, 12, 13]}).withColumn("value_date", F.add_months("value_date", 1))
    )
    heads, members, removed = selection.monthly_rebalances(
        data, products, definitions_frame(spark, four_days), four_days
    )
    assert rows(heads, "effective_date", "eligible_count") == [(DAY, 2)]
    assert rows(members, "cm_product_id") == [(1,), (2,)]
    assert removed.count() == 0


def test_base_date_limits_the_months(spark, four_days):
    late = replace(
        four_days, indexes=(replace(four_days.indexes[0], base_date=date(2026, 9, 1)),)
    )
    data = panel(spark, {1: [10.0, 11, 12, 13], 2: [9.0] * 4})
    heads, _, _ = selection.monthly_rebalances(
        data, catalogue(spark, [1, 2]), definitions_frame(spark, late), late
    )
    assert heads.count() == 0


def test_ranks_are_exact_for_a_group_over_many_partitions(spark):
    data = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("g"),
        (F.col("id") * 7919 % 1009).alias("score"),
        F.col("id"),
    )
    ranked = ranking.rank_within(data, ["g"], [F.desc("score"), F.asc("id")])
    got = {(r.g, r.id): r["rank"] for r in ranked.collect()}
    for group in ("small", "hot"):
        keys = sorted(
            ((-(i * 7919 % 1009), i) for i in range(5000) if (i % 3 == 0) == (group == "small"))
        )
        assert [got[(group, i)] for _, i in keys] == list(range(1, len(keys) + 1))


def test_snapshot_hash_sees_order_and_values(spark):
    schema = "index_code string, effective_date date, rank int, stable_variant_id string, liquidity_score double, avg30 double"
    a = spark.createDataFrame([("X", DAY, 1, "a", 0.9, 1.0), ("X", DAY, 2, "b", 0.8, 1.0)], schema)
    b = spark.createDataFrame([("X", DAY, 2, "a", 0.9, 1.0), ("X", DAY, 1, "b", 0.8, 1.0)], schema)
    sha = [selection.snapshot_fingerprints(x).first().snapshot_sha256 for x in (a, a.orderBy("rank"), b)]
    assert sha[0] == sha[1] != sha[2]


def test_prices_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    from pricetide.queries import views

    dice = random.Random(5)
    columns = "l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_returnflag string, l_shipdate timestamp"
    # 32 prices of four decimals a day: their mean often ends in half of the eighth decimal.
    lines = [
        (dice.randrange(9), 1.0, 1.0, dice.randrange(11) / 100, "O", "N", datetime(1996, 1, 1) + timedelta(days=day))
        for day in range(300)
        for _ in range(32)
    ]
    parts = [(k, "Brand#7", 901.13 + k * 113.71) for k in range(9)]
    found = []
    for name, order in (("forward", lines), ("backward", lines[::-1])):
        spark.createDataFrame(order, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/{name}/part.parquet")
        found.append(rows(views.price_panel(spark, f"{tmp_path}/{name}"), "value_date", "price_avg", "price_low"))
    assert found[0] == found[1]
    exact = {}
    for key, *_, discount, _, _, day in lines:
        exact[day.date()] = exact.get(day.date(), 0) + round((901.13 + key * 113.71) * 100) * (100 - round(discount * 100))
    # Sums are ten-thousandths; a mean's half goes up.
    assert [r[1] for r in found[0]] == [(exact[r[0]] * 10**5 // 32 + 5) // 10 / 10**8 for r in found[0]]
