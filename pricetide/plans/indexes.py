"""Index recalculation, public membership and cutover bundles."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import analytics, chain, gates, membership, selection
from pricetide.params import Methodology, definitions_frame
from pricetide.schemas import CONTRIBUTIONS, DAILY_VALUES, MEMBER, REBALANCE
from pricetide.session import cut_lineage
from pricetide.sinks.exports import write_json
from pricetide.sinks.tables import Receipt, append_receipts, receipts_frame, stored, write_if_changed


@dataclass(frozen=True)
class IndexTables:
    rebalances: DataFrame
    members: DataFrame
    removed: DataFrame
    flagged: DataFrame
    values: DataFrame
    contributions: DataFrame


def calculate(
    prices: DataFrame,
    products: DataFrame,
    calendar: DataFrame,
    method: Methodology,
    run_date: date | None = None,
    scores: DataFrame | None = None,
) -> IndexTables:
    """All indexes of a methodology in one plan; the index code is a key column.

    `scores` from stored summaries (plans/summaries.py) spare the scan of all prices for scoring.

    Members and the flagged panel are read several times below, so both are
    checkpointed; their size is set by target sizes and calendar, not by the
    price volume.
    """
    definitions = definitions_frame(prices.sparkSession, method)
    rebalances, members, removed = selection.monthly_rebalances(
        prices, products, definitions, method, run_date, scores
    )
    members = cut_lineage(members)
    panel = chain.member_panel(prices, members, calendar, definitions, method)
    flagged = cut_lineage(chain.flag_members(panel, method))
    values = chain.link(chain.daily_returns(flagged), definitions, method)
    return IndexTables(
        rebalances, members, removed, flagged, values, chain.contributions(flagged)
    )


def run_calc(
    spark: SparkSession,
    prices: DataFrame,
    products: DataFrame,
    calendar: DataFrame,
    method: Methodology,
    run_date: date,
    root: str,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Recalculate, write changed outputs, quality rows, receipts. Returns the receipts."""
    definitions = definitions_frame(spark, method)
    upto = calendar.filter(F.col("value_date") <= F.lit(run_date))
    t = calculate(prices, products, upto, method, run_date, scores)
    receipts: list[Receipt] = [
        write_if_changed(t.rebalances, f"{root}/rebalances", REBALANCE, ["index_code", "effective_date"]),
        write_if_changed(t.members, f"{root}/members", MEMBER, ["index_code", "effective_date", "rank"]),
        write_if_changed(t.values, f"{root}/daily_values", DAILY_VALUES, ["index_code", "value_date"]),
        write_if_changed(
            t.contributions, f"{root}/contributions", CONTRIBUTIONS, ["index_code", "value_date", "stable_variant_id"]
        ),
    ]
    values = stored(spark, f"{root}/daily_values", DAILY_VALUES)
    contributions = stored(spark, f"{root}/contributions", CONTRIBUTIONS)
    daily, window_rows, ranked = analytics.calculate_analytics(
        values, contributions, products, definitions
    )
    for name, frame in (("daily", daily), ("windows", window_rows), ("rankings", ranked)):
        order = ["index_code", "value_date"]
        receipts.append(write_if_changed(frame, f"{root}/analytics_{name}", frame.schema, order))
    quality = gates.quality_rows(definitions, upto, t.members, values, run_date, method)
    append_receipts(spark, f"{root}/quality", quality, ["index_code", "run_date"])
    runs = quality.select(
        "index_code",
        "run_date",
        "status",
        F.col("available_archive_days").alias("available_days"),
        F.col("required_lookback_days").alias("required_days"),
        "selected_constituents",
        "daily_values",
        "latest_rebalance",
    )
    append_receipts(spark, f"{root}/calc_runs", runs, ["index_code", "run_date"])
    return receipts_frame(spark, receipts)


def membership_contract(
    rebalances: DataFrame,
    members: DataFrame,
    removed: DataFrame,
    definitions: DataFrame,
    products: DataFrame,
    sets: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Public constituents (named intervals) and rebalance records."""
    intervals = membership.lifecycle(members, removed)
    changes = membership.rebalance_changes(intervals, removed)
    records = membership.rebalance_records(rebalances, members, changes)
    return membership.with_catalogue_names(intervals, definitions, products, sets), records


def write_candidate(
    review: DataFrame,
    history: DataFrame,
    intervals: DataFrame,
    rebalances: DataFrame,
    analytics_rows: DataFrame,
    metadata: DataFrame,
    root: str,
) -> bool:
    """Write the cutover bundle when every index passes every gate; returns whether it did."""
    state = gates.overall_state(review, "blocked").first()
    write_json(review.withColumn("gates", F.to_json("gates")), f"{root}/review")
    if state["state"] != gates.ELIGIBLE:
        return False
    tables = {
        "history": history,
        "constituents": intervals,
        "rebalances": rebalances,
        "analytics": analytics_rows,
        "metadata": metadata,
    }
    for name, frame in tables.items():
        write_json(frame, f"{root}/candidate/{name}", ["index_code"])
    return True
