from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricetide.operators import membership, quality
from pricetide.params import definitions_frame
from pricetide.plans.indexes import membership_contract
from pricetide.schemas import INTERVALS, MEMBER, REBALANCE
from tests.conftest import rows

AUG, SEP, OCT = date(2026, 8, 1), date(2026, 9, 1), date(2026, 10, 1)
REMOVED = "index_code string, effective_date date, cm_product_id bigint, variant_key string, action string, reason string"


def contract(spark, one_index):
    def member(day, pid, action):
        return ("TEST5", day, pid, "nonfoil", f"v{pid}", action, f"{action} {pid}", 0.5, 2.0, pid)

    members = spark.createDataFrame(
        [
            member(AUG, 1, "added"), member(AUG, 2, "added"),
            member(SEP, 1, "retained"), member(SEP, 3, "added"),
            member(OCT, 1, "retained"), member(OCT, 2, "added"),
        ],
        MEMBER,
    )
    removed = spark.createDataFrame(
        [("TEST5", SEP, 2, "nonfoil", "removed", "out"), ("TEST5", OCT, 3, "nonfoil", "removed", "out")], REMOVED
    )
    heads = spark.createDataFrame([("TEST5", d, "1", "sha", 3) for d in (AUG, SEP, OCT)], REBALANCE)
    products = spark.createDataFrame(
        [("onepiece", 1, "One", 7), ("onepiece", 2, "Two", 8), ("onepiece", 4, "Four", None)],
        "game_key string, cm_product_id bigint, name string, cm_expansion_id bigint",
    )
    sets = spark.createDataFrame([("onepiece", 7, "Seven")], "game_key string, cm_expansion_id bigint, name string")
    return membership_contract(heads, members, removed, definitions_frame(spark, one_index), products, sets)


def test_reentry_opens_a_second_interval(spark, one_index):
    intervals, records = contract(spark, one_index)
    assert rows(intervals, "cm_product_id", "member_since", "removed_at", "name", "set_name")[1:3] == [
        (2, AUG, SEP, "Two", "Expansion 8"),
        (2, OCT, None, "Two", "Expansion 8"),
    ]
    third = intervals.filter("cm_product_id = 3").first()
    assert (third.name, third.set_name, third.action, third.removal_reason) == ("Product 3", "Unknown set", "removed", "out")
    september = records.filter(F.col("effective_date") == SEP).first()
    assert (september.active_count, september.retained_count) == (2, 1)
    assert [(c.action, c.cm_product_id) for c in september.changes] == [("added", 3), ("removed", 2)]
    changes = records.select("index_code", "effective_date", F.inline("changes"))
    assert quality.change_violations(changes, intervals).count() == 0


def two_intervals(spark):
    a, b, c = date(2026, 7, 20), date(2026, 8, 1), None
    return spark.createDataFrame(
        [
            ("X", 1, "nonfoil", "Nami", "OP01", a, b, "removed", None, None, 0.5, 1.0),
            ("X", 2, "foil", "Zoro", "OP02", b, c, "added", None, None, 0.5, 1.0),
        ],
        INTERVALS,
    )


def test_as_of_and_delta(spark):
    data = two_intervals(spark)
    assert rows(membership.as_of(data, F.lit(date(2026, 7, 31))), "cm_product_id") == [(1,)]
    assert rows(membership.as_of(data, F.lit(AUG)), "cm_product_id") == [(2,)]
    delta = membership.composition_delta(data, F.lit(date(2026, 7, 31)), F.lit(AUG))
    assert rows(delta, "cm_product_id", "change") == [(1, "removed"), (2, "added")]


def test_search(spark):
    data = two_intervals(spark)
    day = F.lit(AUG)
    assert rows(membership.search(data, day, " op02 "), "cm_product_id") == [(2,)]
    assert membership.search(data, day, "nami").count() == 0
    assert rows(membership.search(data, day, "NAMI", include_inactive=True), "cm_product_id") == [(1,)]
    assert membership.search(data, day, "  ").count() == 1


def test_rebalance_weeks(spark):
    records = membership.derived_rebalances(two_intervals(spark))
    assert rows(membership.group_rebalances(records, "week"), "period", "additions", "removals") == [
        ("2026-W30", 1, 0),
        ("2026-W31", 1, 1),
    ]
    with pytest.raises(ValueError):
        membership.group_rebalances(records, "year")


def test_derived_reasons_and_dates(spark):
    data = two_intervals(spark)
    assert rows(membership.derived_changes(data), "cm_product_id", "action", "reason") == [
        (1, "added", "Initial composition"),
        (1, "removed", "Left the selection"),
        (2, "added", "Entered the selection"),
    ]
    defs = spark.createDataFrame([("X", date(2026, 9, 9)), ("Y", AUG)], "index_code string, base_date date")
    assert rows(membership.latest_composition_date(data, defs), "index_code", "latest_date") == [
        ("X", date(2026, 9, 9)),
        ("Y", AUG),
    ]
    assert membership.composition_dates(data, defs).count() == 4


def test_contract_counts_reconcile_between_interval_ends(spark):
    data = two_intervals(spark)
    schema = "index_code string, effective_date date, active_count bigint, retained_count bigint, additions bigint"
    good = spark.createDataFrame([("X", date(2026, 7, 25), 1, 1, 0), ("X", AUG, 1, 0, 1)], schema)
    assert quality.rebalance_contract_violations(good, data).count() == 0
    bad = spark.createDataFrame([("X", date(2026, 7, 1), 1, 1, 0)], schema)
    assert rows(quality.rebalance_contract_violations(bad, data), "violation") == [("active_count",), ("retained_count",)]
