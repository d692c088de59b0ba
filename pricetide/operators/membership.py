"""Membership intervals and composition queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import iso_week

MEMBER_KEY = ["index_code", "cm_product_id", "variant_key"]


# --- from rebalances to intervals -------------------------------------------------


def lifecycle(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Membership intervals: gaps and islands over a variant's add/remove events.

    Every interval starts at the first rebalance that lists the variant after a
    removal (or at all) and ends at the removal. Re-entry opens a new interval. The
    windows hold one variant's rebalances, at most one per month.
    """
    events = members.select(
        *MEMBER_KEY,
        "effective_date",
        F.lit(True).alias("listed"),
        "action",
        "reason",
        "liquidity_score",
        "ref_price",
    ).unionByName(
        removed.select(*MEMBER_KEY, "effective_date", F.lit(False).alias("listed"), "action", "reason"),
        allowMissingColumns=True,
    )
    # Listings of a rebalance count before its removals.
    path = Window.partitionBy(*MEMBER_KEY).orderBy("effective_date", F.desc("listed"))
    island = F.coalesce(
        F.count_if(~F.col("listed")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    opened = F.min_by(
        F.struct("effective_date", "action", "reason", "liquidity_score", "ref_price"),
        F.when(F.col("listed"), F.col("effective_date")),
    )
    closed = F.min_by(
        F.struct("effective_date", "reason"), F.when(~F.col("listed"), F.col("effective_date"))
    )
    return (
        events.withColumn("island", island)
        .groupBy(*MEMBER_KEY, "island")
        .agg(opened.alias("o"), closed.alias("c"))
        # A removal without an open interval closes nothing.
        .filter(F.col("o").isNotNull())
        .select(
            *MEMBER_KEY,
            F.col("o.effective_date").alias("member_since"),
            F.col("c.effective_date").alias("removed_at"),
            F.when(F.col("c").isNotNull(), "removed").otherwise(F.col("o.action")).alias("action"),
            F.col("o.reason").alias("entry_reason"),
            F.col("c.reason").alias("removal_reason"),
            F.col("o.liquidity_score").alias("liquidity_score"),
            F.col("o.ref_price").alias("ref_price"),
        )
    )


def with_catalogue_names(
    intervals: DataFrame, definitions: DataFrame, products: DataFrame, sets: DataFrame
) -> DataFrame:
    """Add product and set names with their fallbacks."""
    games = definitions.select("index_code", "game_key")
    p = products.select("game_key", "cm_product_id", F.col("name").alias("_name"), "cm_expansion_id")
    s = sets.filter(F.col("cm_expansion_id").isNotNull()).select(
        "game_key", "cm_expansion_id", F.col("name").alias("_set")
    )
    pid = F.col("cm_product_id").cast("string")
    set_name = F.when(F.col("cm_expansion_id").isNull(), "Unknown set").otherwise(
        F.coalesce("_set", F.concat(F.lit("Expansion "), F.col("cm_expansion_id").cast("string")))
    )
    return (
        intervals.join(games, "index_code")
        .join(p, ["game_key", "cm_product_id"], "left")
        .join(s, ["game_key", "cm_expansion_id"], "left")
        .withColumn("name", F.coalesce("_name", F.concat(F.lit("Product "), pid)))
        .withColumn("set_name", set_name)
        .drop("game_key", "_name", "_set", "cm_expansion_id")
    )


def rebalance_changes(intervals: DataFrame, removed: DataFrame) -> DataFrame:
    """Public changes: an addition where an interval opens, and every removal."""
    added = intervals.select(
        "index_code",
        F.col("member_since").alias("effective_date"),
        "cm_product_id",
        "variant_key",
        F.lit("added").alias("action"),
        F.col("entry_reason").alias("reason"),
    )
    gone = removed.select(
        "index_code", "effective_date", "cm_product_id", "variant_key", F.lit("removed").alias("action"), "reason"
    )
    return added.unionByName(gone)


def rebalance_records(rebalances: DataFrame, members: DataFrame, changes: DataFrame) -> DataFrame:
    """One record per rebalance: counts and its ordered change list (additions first).

    A change list holds at most the members entering and leaving one rebalance.
    """
    counts = members.groupBy("index_code", "effective_date").agg(
        F.count(F.lit(1)).alias("active_count"),
        F.count_if(F.col("action") == "retained").alias("retained_count"),
    )
    lists = changes.groupBy("index_code", "effective_date").agg(
        F.array_sort(
            F.collect_list(F.struct("action", "cm_product_id", "variant_key", "reason"))
        ).alias("changes")
    )
    keys = ["index_code", "effective_date"]
    return (
        rebalances.join(counts, keys, "left").join(lists, keys, "left").fillna(
            {"active_count": 0, "retained_count": 0}
        )
    )


# --- as-of queries ------------------------------------------------------------------


def active_on(as_of: Column) -> Column:
    """Half-open membership test [member_since, removed_at)."""
    return (F.col("member_since") <= as_of) & (
        F.col("removed_at").isNull() | (F.col("removed_at") > as_of)
    )


def as_of(intervals: DataFrame, day: Column) -> DataFrame:
    return intervals.filter(active_on(day))


def search(
    intervals: DataFrame, day: Column, text: str = "", include_inactive: bool = False
) -> DataFrame:
    """As-of members (or all that ever started) whose name, set, variant or id holds the text."""
    rows = intervals.filter(F.col("member_since") <= day) if include_inactive else as_of(intervals, day)
    query = text.strip().lower()
    if not query:
        return rows
    fields = F.array("name", "set_name", "variant_key", F.col("cm_product_id").cast("string"))
    return rows.filter(F.exists(fields, lambda f: F.contains(F.lower(f), F.lit(query))))


def composition_delta(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Members of two dates compared: change is added, removed or retained.

    One pass and one aggregation instead of two filtered copies joined.
    """
    return (
        intervals.filter(active_on(start) | active_on(end))
        .groupBy(*MEMBER_KEY)
        .agg(
            F.bool_or(active_on(start)).alias("was"),
            F.bool_or(active_on(end)).alias("is"),
            F.max_by("name", "member_since").alias("name"),
        )
        .select(
            *MEMBER_KEY,
            "name",
            F.when(F.col("was") & F.col("is"), "retained")
            .when(F.col("is"), "added")
            .otherwise("removed")
            .alias("change"),
        )
    )


def actions(intervals: DataFrame) -> DataFrame:
    """Interval ends as events: added at the start, removed at the end."""
    start = F.struct(F.col("member_since").alias("date"), F.lit("added").alias("event"))
    end = F.when(
        F.col("removed_at").isNotNull(),
        F.struct(F.col("removed_at").alias("date"), F.lit("removed").alias("event")),
    )
    return intervals.select(
        *MEMBER_KEY, F.explode(F.array_compact(F.array(start, end))).alias("e")
    ).select(*MEMBER_KEY, "e.date", "e.event")


def composition_dates(intervals: DataFrame, definitions: DataFrame, fallback: str = "base_date") -> DataFrame:
    """Distinct lifecycle dates per index plus its fallback date."""
    ends = F.array_compact(F.array("member_since", "removed_at"))
    return (
        intervals.select("index_code", F.explode(ends).alias("date"))
        .unionByName(definitions.select("index_code", F.col(fallback).alias("date")))
        .distinct()
    )


def latest_composition_date(intervals: DataFrame, definitions: DataFrame, fallback: str = "base_date") -> DataFrame:
    """Latest lifecycle date per index, not before its fallback date."""
    latest = intervals.groupBy("index_code").agg(
        F.max(F.greatest("member_since", "removed_at")).alias("latest")
    )
    return definitions.join(latest, "index_code", "left").select(
        "index_code", F.greatest("latest", fallback).alias("latest_date")
    )


def active_counts(intervals: DataFrame) -> DataFrame:
    """Active members at every lifecycle date, as a running sum of interval ends.

    Equal to joining all dates with all intervals, without the theta join: the
    events are first summed per date, then accumulated over the dates of an index.
    """
    events = intervals.select(
        "index_code",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("member_since").alias("d"), F.lit(1).alias("a"), F.lit(0).alias("r")),
                    F.when(
                        F.col("removed_at").isNotNull(),
                        F.struct(F.col("removed_at").alias("d"), F.lit(0).alias("a"), F.lit(1).alias("r")),
                    ),
                )
            )
        ).alias("e"),
    )
    daily = events.groupBy("index_code", F.col("e.d").alias("effective_date")).agg(
        F.sum("e.a").alias("additions"), F.sum("e.r").alias("removals")
    )
    path = Window.partitionBy("index_code").orderBy("effective_date")
    return daily.withColumn(
        "active_count", F.sum(F.col("additions") - F.col("removals")).over(path)
    )


def derived_rebalances(intervals: DataFrame) -> DataFrame:
    """Rebalance records read off the intervals: active and retained counts per date."""
    return active_counts(intervals).withColumn(
        "retained_count", F.greatest(F.col("active_count") - F.col("additions"), F.lit(0))
    )


def derived_changes(intervals: DataFrame) -> DataFrame:
    """Changes read off the intervals, with default reasons."""
    added = (
        intervals.join(composition_starts(intervals), "index_code")
        .select(
            "index_code",
            F.col("member_since").alias("effective_date"),
            "cm_product_id",
            "variant_key",
            F.lit("added").alias("action"),
            F.coalesce(
                "entry_reason",
                F.when(F.col("member_since") == F.col("first_date"), "Initial composition").otherwise(
                    "Entered the selection"
                ),
            ).alias("reason"),
        )
    )
    gone = intervals.filter(F.col("removed_at").isNotNull()).select(
        "index_code",
        F.col("removed_at").alias("effective_date"),
        "cm_product_id",
        "variant_key",
        F.lit("removed").alias("action"),
        F.coalesce("removal_reason", F.lit("Left the selection")).alias("reason"),
    )
    return added.unionByName(gone)


def composition_starts(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("index_code").agg(F.min("member_since").alias("first_date"))


def group_rebalances(records: DataFrame, period: str) -> DataFrame:
    """Rebalances summed per ISO week or month. `records`: additions, removals, retained_count."""
    if period not in ("week", "month"):
        raise ValueError("period must be week or month")
    day = F.col("effective_date")
    label = iso_week(day) if period == "week" else F.date_format(day, "yyyy-MM")
    return records.groupBy("index_code", label.alias("period")).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("additions").alias("additions"),
        F.sum("removals").alias("removals"),
        F.sum("retained_count").alias("retained"),
    )


def lifecycle_row_of_change(changes: DataFrame, intervals: DataFrame) -> DataFrame:
    """The interval a change refers to: one that starts (or ends) on its date, else any
    interval of the variant (the earliest)."""
    keyed = intervals.select(*MEMBER_KEY, "member_since", "removed_at", "name")
    boundary = F.when(F.col("action") == "added", F.col("member_since")).otherwise(F.col("removed_at"))
    exact = F.coalesce(boundary == F.col("effective_date"), F.lit(False))
    change = [*MEMBER_KEY, "effective_date", "action"]
    return (
        changes.select(*change)
        .join(keyed, MEMBER_KEY, "left")
        .groupBy(*change)
        .agg(
            F.min_by(
                F.struct("member_since", "removed_at", "name"), F.struct(~exact, "member_since")
            ).alias("i"),
            F.bool_or(exact).alias("exact"),
        )
        .select(*change, "i.member_since", "i.removed_at", "i.name", "exact")
    )
