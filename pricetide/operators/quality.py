"""Data-quality constraints as violation tables.

Every check returns the rows that break it (all of them, not the first), so a
clean data set gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.membership import MEMBER_KEY, active_counts

# Tolerances and size limits of the public contracts.
RETURN_TOLERANCE = 1e-6
RETURN_CAP = 0.25
HARD_BYTES = 1_000_000
PREFERRED_BYTES = 250_000


def row_violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, violation) for every row and rule whose predicate is not true."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*failed))).alias("violation"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Child rows whose key has no parent row."""
    ref = parent.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key)]).distinct()
    return child.join(ref, child_key, "left_anti")


def threshold_violations(df: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Groups with fewer rows than the minimum."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < minimum)


def self_link_violations(links: DataFrame, source: str, target: str) -> DataFrame:
    return links.filter(F.col(source) == F.col(target))


def orphans(nodes: DataFrame, links: DataFrame, node: str, source: str, kind: str = "parent") -> DataFrame:
    """Nodes without a link of the given kind."""
    linked = links.filter(F.col("type") == kind).select(F.col(source).alias(node)).distinct()
    return nodes.join(linked, node, "left_anti")


def interval_violations(intervals: DataFrame) -> DataFrame:
    """Lifecycle rows with a broken identity, action, period or metric."""
    filled = lambda c: F.length(F.col(c)) > 0
    return row_violations(
        intervals,
        [*MEMBER_KEY, "member_since"],
        {
            "identity": F.col("cm_product_id").isNotNull() & filled("variant_key") & filled("name") & filled("set_name"),
            "action": F.col("member_since").isNotNull()
            & F.col("action").isin("added", "retained", "removed"),
            "removal_after_start": F.col("removed_at").isNull()
            | (F.col("removed_at") > F.col("member_since")),
            "metrics": F.col("liquidity_score").isNotNull() & F.col("ref_price").isNotNull(),
        },
    )


def provenance_violations(definitions: DataFrame, history: DataFrame) -> DataFrame:
    """Index history against its metadata: start date, base date, non-empty when published."""
    base = definitions.select("index_code", "base_date")
    seen = (
        history.join(base, "index_code")
        .groupBy("index_code")
        .agg(
            F.min("value_date").alias("first_date"),
            F.count_if(F.col("value_date") == F.col("base_date")).alias("base_rows"),
        )
    )
    empty = F.col("first_date").isNull()
    return row_violations(
        definitions.join(seen, "index_code", "left"),
        ["index_code"],
        {
            "published_history_empty": ~(empty & (F.col("status") == "published")),
            "history_start_mismatch": empty | (F.col("first_date") == F.col("history_start_date")),
            "base_date_not_observed": empty
            | ((F.col("base_date") >= F.col("history_start_date")) & (F.col("base_rows") > 0)),
        },
    )


def exposure_violations(definitions: DataFrame, history: DataFrame, intervals: DataFrame) -> DataFrame:
    """Published indexes must show history and constituents, others neither."""
    h = history.groupBy("index_code").agg(F.count(F.lit(1)).alias("h"))
    c = intervals.groupBy("index_code").agg(F.count(F.lit(1)).alias("c"))
    joined = (
        definitions.select("index_code", "status")
        .join(h, "index_code", "left")
        .join(c, "index_code", "left")
        .fillna(0, ["h", "c"])
    )
    is_published = F.col("status") == "published"
    return row_violations(
        joined,
        ["index_code"],
        {
            "published_without_data": ~is_published | ((F.col("h") > 0) & (F.col("c") > 0)),
            "unpublished_with_data": is_published | ((F.col("h") == 0) & (F.col("c") == 0)),
        },
    )


def rebalance_contract_violations(records: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rebalance counts that do not reconcile with the intervals.

    `records`: index_code, effective_date, active_count, retained_count, additions.
    A rebalance date without an interval end keeps the count of the last one, found
    by a running last over both date sets (calendar sized).
    """
    counts = active_counts(intervals).select("index_code", "effective_date", F.col("active_count").alias("_active"))
    both = records.join(counts, ["index_code", "effective_date"], "full_outer")
    path = Window.partitionBy("index_code").orderBy("effective_date")
    reconciled = (
        both.withColumn("_active", F.coalesce(F.last("_active", ignorenulls=True).over(path), F.lit(0)))
        .filter(F.col("active_count").isNotNull())
    )
    return row_violations(
        reconciled,
        ["index_code", "effective_date"],
        {
            "active_count": F.col("active_count") == F.col("_active"),
            "retained_count": F.col("retained_count")
            == F.greatest(F.col("_active") - F.col("additions"), F.lit(0)),
        },
    )


def change_violations(changes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Changes without an interval that starts (added) or ends (removed) on their date."""
    ends = intervals.select(
        *MEMBER_KEY,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("member_since").alias("effective_date"), F.lit("added").alias("action")),
                    F.when(
                        F.col("removed_at").isNotNull(),
                        F.struct(F.col("removed_at").alias("effective_date"), F.lit("removed").alias("action")),
                    ),
                )
            )
        ).alias("e"),
    ).select(*MEMBER_KEY, "e.*")
    keys = [*MEMBER_KEY, "effective_date", "action"]
    return changes.join(ends, keys, "left_anti").select(*keys)


def rebalance_order_violations(records: DataFrame, generated_for: DataFrame) -> DataFrame:
    """Repeated rebalance dates, and a latest rebalance that is not the generated one."""
    repeated = unique_violations(records, ["index_code", "effective_date"]).select(
        "index_code", "effective_date", F.lit("date_not_unique").alias("violation")
    )
    latest = records.groupBy("index_code").agg(F.max("effective_date").alias("effective_date"))
    stale = (
        latest.join(generated_for.select("index_code", "generated_for"), "index_code")
        .filter(F.col("effective_date") != F.col("generated_for"))
        .select("index_code", "effective_date", F.lit("generated_for_mismatch").alias("violation"))
    )
    return repeated.unionByName(stale)


def history_violations(history: DataFrame) -> DataFrame:
    """Repeated days, returns above the cap, and stored returns that the values do not imply.

    Broken data may repeat a day any number of times, so rows are first reduced to
    one per index and day; only those are compared with the day before. A repeated
    day is reported as such and not compared.
    """
    keys = ["index_code", "value_date"]
    days = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("index_value").alias("values"),
        F.max("index_value").alias("index_value"),
        F.max("daily_return").alias("daily_return"),
        F.max(F.abs(F.coalesce("daily_return", F.lit(0.0)))).alias("largest"),
    )
    path = Window.partitionBy("index_code").orderBy("value_date")
    stepped = days.withColumn("_before", F.lag("index_value").over(path)).withColumn(
        "_repeated", (F.col("n") > 1) | (F.coalesce(F.lag("n").over(path), F.lit(1)) > 1)
    )
    implied = F.col("index_value") / F.col("_before") - 1
    return row_violations(
        stepped,
        keys,
        {
            "value_missing": (F.col("values") == F.col("n")) & F.col("value_date").isNotNull(),
            "return_above_cap": F.col("largest") <= RETURN_CAP,
            "date_not_unique": F.col("n") == 1,
            "return_mismatch": F.col("_repeated")
            | F.col("_before").isNull()
            | (F.abs(implied - F.col("daily_return")) <= RETURN_TOLERANCE),
        },
    )


def file_violations(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Published files against the manifest: presence, checksum, size limits."""
    joined = declared.select("path", F.col("checksum").alias("declared")).join(
        actual.select("path", "checksum", "bytes"), "path", "left"
    )
    return row_violations(
        joined,
        ["path"],
        {
            "checksum_mismatch": F.col("checksum") == F.col("declared"),
            "exceeds_hard_limit": F.coalesce("bytes", F.lit(0)) <= HARD_BYTES,
            "exceeds_preferred_size": F.coalesce("bytes", F.lit(0)) <= PREFERRED_BYTES,
        },
    )


def build_size_stats(files: DataFrame) -> DataFrame:
    """File count, bytes, largest file and files over the limits."""
    return files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("bytes").cast("bigint").alias("total_bytes"),
        F.min_by("path", F.struct(-F.col("bytes"), F.col("path"))).alias("largest_path"),
        F.max("bytes").cast("bigint").alias("largest_bytes"),
        F.count_if(F.col("bytes") > HARD_BYTES).alias("over_hard"),
        F.count_if(F.col("bytes") > PREFERRED_BYTES).alias("over_preferred"),
    )


def status_violations(status: DataFrame, expected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stated status rows against the recomputed ones: gaps, version and latest dates.

    Both sides hold one row, or one for each of `keys`; a key that one side lacks differs in all.
    """
    keys = keys or []
    facts = [c for c in expected.columns if c in status.columns and c not in keys]
    if keys:
        target = expected.select(*keys, F.struct(*facts).alias("_expected"))
        both = status.join(target, keys, "full_outer")
    else:
        both = status.withColumn("_expected", expected.select(F.struct(*facts)).scalar())
    return row_violations(both, keys, {c: F.col(c).eqNullSafe(F.col(f"_expected.{c}")) for c in facts})


def health_violations(health: DataFrame) -> DataFrame:
    """Archive-health contract: status domain, coverage range, gap count equals the gap list."""
    return row_violations(
        health,
        ["key"],
        {
            "status": F.col("status").isin("pending_first_audit", "healthy", "attention_required"),
            "coverage_range": F.col("coverage_ratio").isNull() | F.col("coverage_ratio").between(0, 1),
            "gap_count": F.col("gap_count").isNull() | (F.col("gap_count") == F.size("gaps")),
        },
    )


def readiness_violations(items: DataFrame) -> DataFrame:
    """Readiness contract rows: state domain, integers present, blockers listed."""
    return row_violations(
        items,
        ["index_code"],
        {
            "state": F.col("state").isin("pending_receipt", "accumulating", "eligible_for_human_review"),
            "required_days": F.col("required_days").isNotNull(),
            "target_size": F.col("target_size").isNotNull(),
            "blockers": F.col("blockers").isNotNull(),
        },
    )


def definition_violations(definitions: DataFrame) -> DataFrame:
    """Domain checks of index definitions."""
    return row_violations(
        definitions,
        ["index_code"],
        {
            "universe": F.col("universe").isin("singles", "sealed"),
            "status": F.col("status").isin("draft", "accumulating", "published", "retired"),
            "target_size": F.col("target_size") > 0,
        },
    )


def product_violations(products: DataFrame) -> DataFrame:
    """Domain checks of catalogue products."""
    return row_violations(
        products,
        ["game_key", "cm_product_id"],
        {
            "product_kind": F.col("product_kind").isin("single", "sealed", "other"),
            "name": F.length("name") > 0,
            "seen_order": F.col("first_seen") <= F.col("last_seen"),
        },
    )


def universe_coverage(definitions: DataFrame) -> DataFrame:
    """Definitions per game and universe, and whether each game has exactly one of both."""
    counts = (
        definitions.groupBy("game_key").pivot("universe", ["singles", "sealed"]).count().fillna(0)
    )
    return counts.withColumn("complete", (F.col("singles") == 1) & (F.col("sealed") == 1))


def contribution_invariants(values: DataFrame, contributions: DataFrame, cap: float) -> DataFrame:
    """Days whose contributions do not add up, and returns beyond the cap."""
    sums = contributions.groupBy("index_code", "value_date").agg(
        F.sum("contribution").alias("total"),
        F.max(F.abs("used_return")).alias("largest"),
        F.count(F.lit(1)).alias("rows"),
    )
    return row_violations(
        values.join(sums, ["index_code", "value_date"], "left"),
        ["index_code", "value_date"],
        {
            "sum_of_contributions": F.abs(F.col("total") - F.col("daily_return")) <= 1e-12,
            "cap": F.col("largest") <= cap,
            "active_rows": F.col("rows") == F.col("n_constituents_active"),
        },
    )
