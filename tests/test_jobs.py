from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pricetide.operators import gates, merge, quality
from pricetide.params import IndexDefinition, Methodology, definitions_frame
from pricetide.plans.indexes import run_calc, write_candidate
from pricetide.schemas import CALC_RECEIPT, HISTORY, PRICES
from pricetide.sinks import exports, tables
from pricetide.streaming import prices as stream_prices
from pricetide.streaming import requests
from tests.conftest import rows

DAY = date(2026, 8, 1)


def test_readiness_state(spark):
    method = Methodology(
        indexes=tuple(IndexDefinition(f"I{i}", f"I{i}", f"g{i}", "singles", 5, DAY) for i in range(20))
    )
    defs = definitions_frame(spark, method)
    receipts = spark.createDataFrame([(f"I{i}", DAY, "accumulating", 2, 60, 0) for i in range(20)], CALC_RECEIPT)
    pairs = spark.createDataFrame(
        [(f"g{i}", k) for i in range(20) for k in ("priceguide", "catalogue")], "game_key string, kind string"
    )
    items = gates.readiness(defs, receipts, pairs)
    first = items.orderBy("index_code").first()
    assert first.days_remaining == 58 and "lookback_complete" in first.blockers
    assert "snapshot_verified" not in first.blockers
    assert gates.overall_state(items, "collecting").first().state == "collecting"
    assert gates.code_mismatch(defs, receipts.filter("index_code <> 'I3'")).first().index_code == "I3"
    assert rows(quality.universe_coverage(defs).limit(1), "singles", "sealed", "complete") == [(1, 0, False)]
    partial = gates.readiness(defs, receipts, pairs.filter("kind = 'catalogue'"))
    assert "snapshot_verified" in partial.first().blockers


def synthetic(spark, days=70):
    """Three singles over some weeks, dense enough for a selection of two."""
    data = []
    for pid in (1, 2, 3):
        for i in range(days):
            price = 10.0 + pid + (i * (pid + 1)) % 7
            data.append(
                (f"cardmarket:onepiece:product:{pid}:nonfoil", f"cardmarket:onepiece:product:{pid}", "onepiece", pid, 1,
                 "single", date(2026, 6, 1) + timedelta(days=i), "nonfoil", price - 1, price, None, None, price)
            )
    return spark.createDataFrame(data, PRICES)


def test_run_calc_writes_once(spark, tmp_path):
    method = Methodology(
        seasoning_days=0, selection_lookback_days=20, min_history_days=10, min_observation_ratio=0.5,
        price_floor_observation_ratio=0.5,
        indexes=(IndexDefinition("T2", "Two", "onepiece", "singles", 2, date(2026, 1, 1)),),
    )
    prices = synthetic(spark)
    products = spark.createDataFrame(
        [("onepiece", p, f"P{p}", "2020-01-01", date(2020, 1, 1)) for p in (1, 2, 3)],
        "game_key string, cm_product_id bigint, name string, source_date_added string, first_seen date",
    )
    from pricetide.operators.chain import price_calendar

    root = str(tmp_path / "out")
    run = date(2026, 8, 5)
    first = run_calc(spark, prices, products, price_calendar(prices), method, run, root)
    assert first.filter("changed").count() == first.count() == 7
    again = run_calc(spark, prices, products, price_calendar(prices), method, run, root)
    assert again.filter("changed").count() == 0
    q = tables.read_stored(spark, f"{root}/quality").first()
    assert (q.status, q.selected_constituents, q.available_archive_days) == ("ready", 2, 66)
    members = tables.read_stored(spark, f"{root}/members")
    assert rows(members.groupBy("effective_date").count(), "effective_date", "count") == [(date(2026, 7, 1), 2), (DAY, 2)]
    values = tables.read_stored(spark, f"{root}/daily_values")
    assert values.agg(F.min("value_date"), F.max("value_date")).first() == (date(2026, 7, 1), run)


def test_candidate_needs_every_gate(spark, tmp_path):
    review = spark.createDataFrame([("A", gates.ELIGIBLE), ("B", "blocked")], "index_code string, state string").withColumn(
        "gates", F.create_map(F.lit("x"), F.lit(True))
    )
    part = review.select("index_code", F.lit(1).alias("n"))
    assert not write_candidate(review, part, part, part, part, part, str(tmp_path / "a"))
    assert not (tmp_path / "a" / "candidate").exists()
    good = review.withColumn("state", F.lit(gates.ELIGIBLE))
    assert write_candidate(good, part, part, part, part, part, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "candidate" / "history")).count() == 2


def test_outputs_need_matching_fingerprints(spark):
    schema = "index_code string, output string, fingerprint string"
    declared = spark.createDataFrame([("A", "x", "1"), ("A", "y", "2"), ("B", "x", "1")], schema)
    actual = spark.createDataFrame([("A", "x", "1"), ("A", "y", "other"), ("B", "x", "1")], schema)
    assert rows(gates.outputs_verified(declared, actual), "index_code", "verified") == [("A", False), ("B", True)]


def test_fingerprint_ignores_order_and_files(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert tables.measure(a) == tables.measure(a.repartition(7).orderBy(F.desc("id")))
    assert tables.measure(a) != tables.measure(a.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int")))
    assert tables.measure(a.limit(0))[0] == 0


def test_append_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    assert rows(merge.append_only_violations(old, new, ["k"]), "k", "violation") == [(2, "updated"), (3, "deleted")]
    assert merge.append_only_violations(old, old, ["k"]).count() == 0


def test_history_rules(spark):
    good = [("X", DAY, 100.0, 0.0), ("X", DAY + timedelta(days=1), 110.0, 0.1)]
    frame = lambda data: spark.createDataFrame([(*r, 1, 0, 0, "1") for r in data], HISTORY)
    assert quality.history_violations(frame(good)).count() == 0
    bad = [*good, ("X", DAY + timedelta(days=1), 200.0, 0.5)]
    found = {r.violation for r in quality.history_violations(frame(bad)).collect()}
    assert found == {"return_above_cap", "date_not_unique"}
    drift = [good[0], ("X", DAY + timedelta(days=1), 110.0, 0.2)]
    assert rows(quality.history_violations(frame(drift)), "violation") == [("return_mismatch",)]


def test_public_export(spark, tmp_path):
    defs = spark.createDataFrame(
        [("A", "published", "published"), ("B", "accumulating", "validation")],
        "index_code string, status string, history_start_kind string",
    )
    history = spark.createDataFrame(
        [("A", DAY, 1000.0, 0.0, 2, None, None, None), ("B", DAY, 5.0, 0.0, 1, 0, 0, "1")], HISTORY
    )
    exports.write_public_export(defs, defs, history, history, history, defs, str(tmp_path / "x"))
    assert rows(spark.read.json(str(tmp_path / "x" / "history")), "index_code") == [("A",)]
    assert spark.read.json(str(tmp_path / "x" / "summary")).count() == 2
    exports.write_history_csv(history, defs, str(tmp_path / "csv"))
    lines = [p.read_text() for p in (tmp_path / "csv").rglob("*.csv")]
    assert lines == [",".join(exports.CSV_COLUMNS) + "\n2026-08-01,1000.000000,0.00000000,2,0,0,\n"]


def brute_limits(events, limit, window):
    seen, out = {}, {}
    for key, seq, ms in sorted(events, key=lambda e: (e[2], e[1])):
        active = [t for t in seen.get(key, []) if ms - t < window] + [ms]
        seen[key] = active
        out[seq] = (len(active), len(active) > limit)
    return out


def limit_events(spark):
    import random

    rng = random.Random(3)
    # One key owns most of the events, and many share a millisecond.
    data = [(1 if rng.random() < 0.8 else 2, i, rng.randrange(0, 40_000) // 10 * 10) for i in range(600)]
    return data, spark.createDataFrame(data, "k bigint, seq bigint, ms bigint")


def test_rate_limit_matches_a_loop(spark):
    data, frame = limit_events(spark)
    got = requests.rate_limited(frame, "k", "seq", limit=5, window_ms=1000)
    assert {r.seq: (r.requests_in_window, r.limited) for r in got.collect()} == brute_limits(data, 5, 1000)


def test_streamed_rate_limit_continues_over_batches(spark, tmp_path):
    data, frame = limit_events(spark)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for low in (0, 13_000, 26_000):
        frame.filter((F.col("ms") >= low) & (F.col("ms") < low + 13_000 + 2000 * (low == 26_000))).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        requests.start_rate_limit(spark, stream, "k", "seq", root, limit=5, window_ms=1000).awaitTermination()
    got = spark.read.parquet(f"{root}/verdicts")
    assert {r.seq: (r.requests_in_window, r.limited) for r in got.collect()} == brute_limits(data, 5, 1000)


def test_member_state_continues_over_batches(spark, tmp_path, one_index):
    from pricetide.operators import chain

    days = [DAY + timedelta(days=i) for i in range(9)]
    used = [10.0, None, 12.0, 30.0, None, None, None, 11.0, 11.0]
    panel = spark.createDataFrame(
        [("X", 1, "nonfoil", d, p, d == days[8], DAY, "v") for d, p in zip(days, used)],
        "index_code string, cm_product_id bigint, variant_key string, value_date date, used_price double,"
        " unchanged boolean, effective_date date, stable_variant_id string",
    )
    method = replace(one_index, carry_forward_max_days=2)
    want = rows(chain.flag_members(panel, method), "value_date", "flag", "used_return")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    flags = stream_prices.MemberFlags(spark, method, root, delay_days=2)
    at = F.col("value_date")
    # Day 3 comes after day 4, days 0 and 4 come twice.
    for part in ((at < days[5]) & (at != days[3]), (at >= days[5]) | at.isin(days[0], days[3], days[4])):
        panel.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(panel.schema).parquet(source)
        flags.start(stream).awaitTermination()
    flags.close(panel.schema)
    assert rows(flags.flags(), "value_date", "flag", "used_return") == want
    # A batch that is repeated gives the same rows.
    flags.judge(panel.filter((at >= days[5]) | at.isin(days[0], days[3], days[4])), 1)
    assert rows(flags.flags(), "value_date", "flag", "used_return") == want
    assert rows(spark.read.parquet(f"{root}/late"), "value_date") == [(days[0],)]
    assert [w[1] for w in want] == [
        "initialized", "carried_forward", "fresh", "spike_capped", "carried_forward", "carried_forward", "stale", "spike_capped", "snapshot_unchanged",
    ]


def test_parameter_files(tmp_path):
    raw = {
        "methodology_version": "9", "price_field_primary": "price_avg", "price_field_fallback": "price_low",
        "min_price_eur": {"singles": 2, "sealed": 10}, "seasoning_days": 1, "min_history_days": 1,
        "min_observation_ratio": 0.5, "price_floor_observation_ratio": 0.5, "max_suspect_zero_ratio": 0.1,
        "daily_return_cap": 0.2, "carry_forward_max_days": 1, "selection_lookback_days": 30,
        "buffer_retention_multiplier": 1.2, "buffer_entry_multiplier": 0.9,
        "indexes": [{"code": "A", "name": "A", "game_key": "g", "universe": "sealed", "target_size": "5", "base_date": "2026-01-01", "language_scope": ["EN"]}],
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps(raw))
    method = Methodology.load(path)
    a = method.index_by_code("A")
    assert (a.product_kind, a.base_date, a.language_scope_status) == ("sealed", date(2026, 1, 1), "pending_source_field")
    assert method.enabled(["other"]).indexes == ()
    with pytest.raises(KeyError):
        method.index_by_code("B")
    del raw["daily_return_cap"]
    path.write_text(json.dumps(raw))
    with pytest.raises(KeyError):
        Methodology.load(path)
