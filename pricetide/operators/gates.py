"""Readiness, audit and cutover gates: named booleans, blockers and states."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.params import LANGUAGE_PENDING, SOURCE_KINDS, Methodology

ELIGIBLE = "eligible_for_human_review"


def gate_map(gates: dict[str, Column]) -> Column:
    """Gates as a map name -> boolean; an unknown gate counts as not passed."""
    parts: list[Column] = []
    for name, passed in gates.items():
        parts += [F.lit(name), F.coalesce(passed, F.lit(False))]
    return F.create_map(*parts)


def blockers(gates: Column) -> Column:
    """Names of the gates not passed, in map order."""
    return F.map_keys(F.map_filter(gates, lambda _, passed: ~passed))


def with_state(df: DataFrame, gates: dict[str, Column], otherwise: str) -> DataFrame:
    return (
        df.withColumn("gates", gate_map(gates))
        .withColumn("blockers", blockers(F.col("gates")))
        .withColumn("state", F.when(F.size("blockers") == 0, ELIGIBLE).otherwise(otherwise))
    )


def overall_state(indexes: DataFrame, otherwise: str) -> DataFrame:
    """State of the whole set: eligible only when every index is."""
    return indexes.agg(
        F.when(F.bool_and(F.col("state") == ELIGIBLE), ELIGIBLE).otherwise(otherwise).alias("state"),
        F.count(F.lit(1)).alias("indexes"),
        F.count_if(F.col("state") == ELIGIBLE).alias("eligible"),
    )


def code_mismatch(definitions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Index codes missing from, or unexpected in, the calculation receipt."""
    return (
        definitions.select("index_code", F.lit(1).alias("d"))
        .join(receipts.select("index_code", F.lit(1).alias("r")).distinct(), "index_code", "full_outer")
        .filter(F.col("d").isNull() | F.col("r").isNull())
        .select(
            "index_code", F.when(F.col("r").isNull(), "missing").otherwise("unexpected").alias("problem")
        )
    )


def pairs_complete(definitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: is every expected (game, kind) pair among the observed ones?"""
    kinds = F.explode(F.array(*[F.lit(k) for k in SOURCE_KINDS])).alias("kind")
    wanted = definitions.select("game_key").distinct().select("game_key", kinds)
    return (
        wanted.join(pairs.select("game_key", "kind").distinct(), ["game_key", "kind"], "left_anti")
        .agg((F.count(F.lit(1)) == 0).alias("snapshot_verified"))
    )


def readiness(definitions: DataFrame, receipts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Five gates per index from the calculation receipt and the archive's pairs."""
    joined = definitions.join(
        receipts.select(
            "index_code",
            F.col("status").alias("calc_status"),
            "available_days",
            "required_days",
            "selected_constituents",
        ),
        "index_code",
    ).withColumn("snapshot_verified", pairs_complete(definitions, pairs).scalar())
    out = with_state(
        joined,
        {
            "snapshot_verified": F.col("snapshot_verified"),
            "lookback_complete": F.col("available_days") >= F.col("required_days"),
            "target_size_filled": F.col("selected_constituents") == F.col("target_size"),
            "language_scope_resolved": F.col("language_scope_status") != LANGUAGE_PENDING,
            "shadow_calculation_ready": F.col("calc_status") == "ready",
        },
        "accumulating",
    )
    return out.select(
        "index_code",
        "state",
        "available_days",
        "required_days",
        F.greatest(F.col("required_days") - F.col("available_days"), F.lit(0)).alias("days_remaining"),
        "selected_constituents",
        "target_size",
        "gates",
        "blockers",
    )


def latest_quality(quality: DataFrame, until: Column) -> DataFrame:
    """Newest quality receipt of each index that is not later than `until`."""
    rest = [c for c in quality.columns if c not in ("index_code", "run_date")]
    return (
        quality.filter(F.col("run_date") <= until)
        .groupBy("index_code")
        .agg(F.max_by(F.struct("run_date", *rest), "run_date").alias("q"))
        .select("index_code", "q.*")
    )


def audit_readiness(
    definitions: DataFrame,
    quality: DataFrame,
    until: Column,
    fallback_available: Column,
    required_days: int,
) -> DataFrame:
    """Four gates per index from its latest quality receipt."""
    latest = latest_quality(quality, until).select(
        "index_code",
        F.lit(True).alias("has_quality"),
        F.col("run_date").alias("quality_run_date"),
        F.col("available_archive_days").alias("q_available"),
        F.col("required_lookback_days").alias("q_required"),
        F.col("selected_constituents").alias("q_selected"),
        F.col("target_size").alias("q_target"),
        F.col("language_scope_status").alias("q_language"),
    )
    joined = (
        definitions.select("index_code")
        .join(latest, "index_code", "left")
        .withColumn("available_archive_days", F.coalesce("q_available", fallback_available))
        .withColumn("required_lookback_days", F.coalesce("q_required", F.lit(required_days)))
        .withColumn("language", F.coalesce("q_language", F.lit("unknown")))
    )
    out = with_state(
        joined,
        {
            "quality_receipt_available": F.col("has_quality"),
            "lookback_complete": F.col("available_archive_days") >= F.col("required_lookback_days"),
            "target_size_filled": F.col("q_selected") == F.col("q_target"),
            "language_scope_resolved": ~F.col("language").isin(LANGUAGE_PENDING, "unknown"),
        },
        "accumulating",
    )
    return out.select(
        "index_code",
        "state",
        "quality_run_date",
        "available_archive_days",
        "required_lookback_days",
        F.greatest(
            F.col("required_lookback_days") - F.col("available_archive_days"), F.lit(0)
        ).alias("days_remaining"),
        "blockers",
    )


def outputs_verified(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Per index: every declared output exists with the declared fingerprint.

    An index without declarations gets no row here and fails the gate.
    """
    joined = declared.select("index_code", "output", F.col("fingerprint").alias("declared")).join(
        actual.select("index_code", "output", "fingerprint"), ["index_code", "output"], "left"
    )
    return joined.groupBy("index_code").agg(
        F.bool_and(F.coalesce(F.col("declared") == F.col("fingerprint"), F.lit(False))).alias("verified"),
        F.count(F.lit(1)).alias("outputs"),
    )


def cutover_review(
    definitions: DataFrame,
    quality: DataFrame,
    calc_manifests: DataFrame,
    audit_states: DataFrame,
    verified: DataFrame,
    audit_passed: Column,
    run_date: date,
    method: Methodology,
) -> DataFrame:
    """Nine gates per index. All inputs hold one row per index (and day)."""
    day = F.lit(run_date)
    q = quality.filter(F.col("run_date") == day).select(
        "index_code",
        F.lit(True).alias("has_quality"),
        F.col("status").alias("q_status"),
        F.col("available_archive_days").alias("q_available"),
        F.col("required_lookback_days").alias("q_required"),
        F.col("selected_constituents").alias("q_selected"),
        F.col("target_size").alias("q_target"),
        F.col("language_scope_status").alias("q_language"),
    )
    m = calc_manifests.select(
        "index_code",
        F.col("generated_for").alias("m_date"),
        F.col("status").alias("m_status"),
        F.col("methodology_version").alias("m_version"),
    )
    a = audit_states.select("index_code", F.col("state").alias("a_state"))
    v = verified.select("index_code", F.col("verified").alias("v_ok"))
    joined = definitions
    for side in (q, m, a, v):
        joined = joined.join(side, "index_code", "left")
    out = with_state(
        joined,
        {
            "archive_audit_passed": audit_passed,
            "audit_index_ready": F.col("a_state") == ELIGIBLE,
            "quality_receipt_available": F.col("has_quality"),
            "quality_status_ready": F.col("q_status") == "ready",
            "lookback_complete": F.col("q_available") >= F.col("q_required"),
            "target_size_filled": F.col("q_selected") == F.col("q_target"),
            "language_scope_resolved": (F.col("q_language") == F.col("language_scope_status"))
            & (F.col("language_scope_status") != LANGUAGE_PENDING),
            "calculation_manifest_matches": (F.col("m_date") == day)
            & (F.col("m_status") == "ready")
            & (F.col("m_version") == method.methodology_version),
            "calculation_outputs_verified": F.col("v_ok"),
        },
        "blocked",
    )
    return out.select(
        "index_code",
        "state",
        F.col("q_available").alias("available_archive_days"),
        F.col("q_required").alias("required_lookback_days"),
        F.col("q_selected").alias("selected_constituents"),
        F.coalesce("q_target", "target_size").alias("target_size"),
        "gates",
        "blockers",
    )


def quality_rows(
    definitions: DataFrame,
    calendar: DataFrame,
    members: DataFrame,
    values: DataFrame,
    run_date: date,
    method: Methodology,
) -> DataFrame:
    """One quality row per index: archive days, selection size, value days and status."""
    days = calendar.groupBy("game_key").agg(F.count_distinct("value_date").alias("available_archive_days"))
    sizes = members.groupBy("index_code", "effective_date").agg(F.count(F.lit(1)).alias("n"))
    latest = sizes.groupBy("index_code").agg(
        F.max("effective_date").alias("latest_rebalance"),
        F.max_by("n", "effective_date").alias("selected_constituents"),
    )
    vals = values.groupBy("index_code").agg(
        F.count(F.lit(1)).alias("daily_values"), F.max("value_date").alias("latest_value_date")
    )
    required = method.selection_lookback_days
    return (
        definitions.join(days, "game_key", "left")
        .join(latest, "index_code", "left")
        .join(vals, "index_code", "left")
        .fillna({"available_archive_days": 0, "selected_constituents": 0, "daily_values": 0})
        .select(
            "index_code",
            F.lit(run_date).alias("run_date"),
            F.when(
                (F.col("selected_constituents") == F.col("target_size")) & (F.col("daily_values") > 0),
                "ready",
            )
            .otherwise("accumulating")
            .alias("status"),
            "available_archive_days",
            F.lit(required).alias("required_lookback_days"),
            F.greatest(F.lit(required) - F.col("available_archive_days"), F.lit(0)).alias(
                "days_remaining_before_full_lookback"
            ),
            "target_size",
            "selected_constituents",
            "daily_values",
            # Analytics has one row per daily value.
            F.col("daily_values").alias("analytics_days"),
            F.col("latest_value_date").alias("latest_analytics_date"),
            "latest_rebalance",
            "language_scope_status",
        )
    )
