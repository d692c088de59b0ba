"""Gates, constraints, sinks and request limit queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import chain, gates, membership, merge, quality
from pricetide.params import LANGUAGE_PENDING, LANGUAGE_RESOLVED
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.schemas import PRICES, struct
from pricetide.session import cut_lineage
from pricetide.sinks import exports, tables
from pricetide.streaming import prices as stream_prices
from pricetide.streaming import requests

_RUN = date(1998, 1, 1)

# Every customer is treated as an index with its own receipts.
views.SQL.update(
    {
        "customer_indexes": (
            [],
            f"""SELECT c_name AS index_code, CASE WHEN c_custkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, CAST(c_custkey % 5 + 8 AS INT) AS target_size,
            CASE WHEN c_custkey % 6 = 0 THEN '{LANGUAGE_PENDING}' ELSE '{LANGUAGE_RESOLVED}' END AS language_scope_status, c_custkey FROM customer""",
        ),
        "receipts": (
            ["customer_indexes"],
            """SELECT c.index_code, c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'ready' ELSE 'accumulating' END AS status, count(DISTINCT CAST(o_orderdate AS DATE)) AS available_days, 10 AS required_days, count(o_orderkey) AS selected_constituents
            FROM customer_indexes c JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
        ),
        "quality_receipts": (
            ["receipts", "customer_indexes"],
            """SELECT index_code, DATE '1998-01-01' + CAST(shift + r.c_custkey % 3 AS INT) AS run_date, r.status, available_days + shift AS available_archive_days, 10 AS required_lookback_days, target_size, selected_constituents, language_scope_status
            FROM receipts r JOIN customer_indexes c USING (index_code), (VALUES (-5), (0), (7)) s(shift) WHERE r.c_custkey % 8 <> 7""",
        ),
    }
)


def _customer_indexes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return views.table(spark, sf, "customer").select(
        F.col("c_name").alias("index_code"),
        views.part_game(k).alias("game_key"),
        (k % 5 + 8).cast("int").alias("target_size"),
        F.when(k % 6 == 0, LANGUAGE_PENDING).otherwise(LANGUAGE_RESOLVED).alias("language_scope_status"),
        k,
    )


def _receipts(spark: SparkSession, sf: str) -> DataFrame:
    codes = _customer_indexes(spark, sf).select("index_code", "c_custkey")
    orders = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_distinct(F.to_date("o_orderdate")).alias("available_days"),
        F.count(F.lit(1)).alias("selected_constituents"),
    )
    return codes.join(orders, "c_custkey").select(
        "index_code",
        "c_custkey",
        F.when(F.col("c_custkey") % 4 != 0, "ready").otherwise("accumulating").alias("status"),
        "available_days",
        F.lit(10).alias("required_days"),
        "selected_constituents",
    )


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _receipts(spark, sf).join(_customer_indexes(spark, sf).drop("c_custkey", "game_key"), "index_code")
    shift = F.explode(F.array(F.lit(-5), F.lit(0), F.lit(7)))
    return (
        rows.filter(F.col("c_custkey") % 8 != 7)
        .withColumn("shift", shift)
        .select(
            "index_code",
            F.date_add(F.lit(_RUN), (F.col("shift") + F.col("c_custkey") % 3).cast("int")).alias("run_date"),
            "status",
            (F.col("available_days") + F.col("shift")).alias("available_archive_days"),
            F.lit(10).alias("required_lookback_days"),
            "target_size",
            "selected_constituents",
            "language_scope_status",
        )
    )


# --- gates ---------------------------------------------------------------------------


@query(
    "receipt_code_mismatch",
    "J12 D14",
    "index_code:s problem:s",
    """SELECT coalesce(c.index_code, r.index_code) AS index_code, CASE WHEN r.index_code IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
    FROM (SELECT index_code FROM customer_indexes WHERE c_custkey % 7 <> 0) c FULL JOIN receipts r ON r.index_code = c.index_code WHERE c.index_code IS NULL OR r.index_code IS NULL""",
    ["customer_indexes", "receipts"],
)
def receipt_code_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    known = _customer_indexes(spark, sf).filter(F.col("c_custkey") % 7 != 0)
    return gates.code_mismatch(known, _receipts(spark, sf))


@query(
    "expected_pairs",
    "J21",
    "run_date:s snapshot_verified:b",
    """SELECT d.run_date, count(f.kind) = 4 AS snapshot_verified FROM (SELECT DISTINCT run_date FROM manifest_files) d
    LEFT JOIN manifest_files f ON f.run_date = d.run_date GROUP BY 1""",
    ["manifest_files"],
)
def expected_pairs(spark: SparkSession, sf: str) -> DataFrame:
    files = views.manifest_files(spark, sf)
    days = files.select("run_date").distinct()
    kinds = F.explode(F.array(F.lit("priceguide"), F.lit("catalogue"))).alias("kind")
    games = F.explode(F.array(F.lit("onepiece"), F.lit("pokemon"))).alias("game_key")
    wanted = days.select("run_date", games).select("run_date", "game_key", kinds)
    gaps = wanted.join(files, ["run_date", "game_key", "kind"], "left_anti")
    missing = gaps.groupBy("run_date").agg(F.count(F.lit(1)).alias("missing"))
    return days.join(missing, "run_date", "left").withColumn("snapshot_verified", F.col("missing").isNull())


@query(
    "readiness_gates",
    "J14 J21 A28 D14 F17",
    "index_code:s state:s available_days:i required_days:i days_remaining:i selected_constituents:i target_size:i blockers:s",
    f"""SELECT *, CASE WHEN blockers = '' THEN 'eligible_for_human_review' ELSE 'accumulating' END AS state FROM (
      SELECT c.index_code, available_days, required_days, greatest(required_days - available_days, 0) AS days_remaining, selected_constituents, target_size,
      concat_ws(',', CASE WHEN (SELECT count(DISTINCT game_key || kind) FROM manifest_files) < 4 THEN 'snapshot_verified' END, CASE WHEN available_days < required_days THEN 'lookback_complete' END,
        CASE WHEN selected_constituents <> target_size THEN 'target_size_filled' END, CASE WHEN language_scope_status = '{LANGUAGE_PENDING}' THEN 'language_scope_resolved' END,
        CASE WHEN status <> 'ready' THEN 'shadow_calculation_ready' END) AS blockers FROM customer_indexes c JOIN receipts r USING (index_code))""",
    ["customer_indexes", "receipts", "manifest_files"],
)
def readiness_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.readiness(_customer_indexes(spark, sf), _receipts(spark, sf), views.manifest_files(spark, sf))
    return rows.withColumn("blockers", F.array_join("blockers", ","))


@query(
    "readiness_state",
    "A28 D14",
    "state:s indexes:i eligible:i",
    f"""SELECT CASE WHEN bool_and(ok) THEN 'eligible_for_human_review' ELSE 'collecting' END AS state, count(*) AS indexes, count(*) FILTER (ok) AS eligible FROM (
      SELECT available_days >= required_days AND selected_constituents = target_size AND language_scope_status <> '{LANGUAGE_PENDING}' AND status = 'ready'
        AND (SELECT count(DISTINCT game_key || kind) FROM manifest_files) = 4 AS ok FROM customer_indexes c JOIN receipts r USING (index_code))""",
    ["customer_indexes", "receipts", "manifest_files"],
)
def readiness_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.readiness(_customer_indexes(spark, sf), _receipts(spark, sf), views.manifest_files(spark, sf))
    return gates.overall_state(rows, "collecting")


@query(
    "latest_quality_receipts",
    "J23",
    "index_code:s run_date:s available_archive_days:i status:s",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY run_date DESC) AS rn FROM quality_receipts WHERE run_date <= DATE '1998-01-01') WHERE rn = 1""",
    ["quality_receipts"],
)
def latest_quality_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return gates.latest_quality(_quality(spark, sf), F.lit(_RUN))


@query(
    "audit_gates",
    "A28 J23 D10",
    "index_code:s state:s quality_run_date:s available_archive_days:i required_lookback_days:i days_remaining:i blockers:s",
    f"""SELECT *, CASE WHEN blockers = '' THEN 'eligible_for_human_review' ELSE 'accumulating' END AS state, greatest(required_lookback_days - available_archive_days, 0) AS days_remaining FROM (
      SELECT c.index_code, q.run_date AS quality_run_date, coalesce(q.available_archive_days, 7) AS available_archive_days, coalesce(q.required_lookback_days, 60) AS required_lookback_days,
      concat_ws(',', CASE WHEN q.index_code IS NULL THEN 'quality_receipt_available' END, CASE WHEN coalesce(q.available_archive_days, 7) < coalesce(q.required_lookback_days, 60) THEN 'lookback_complete' END,
        CASE WHEN NOT coalesce(q.selected_constituents = q.target_size, false) THEN 'target_size_filled' END,
        CASE WHEN coalesce(q.language_scope_status, 'unknown') IN ('{LANGUAGE_PENDING}', 'unknown') THEN 'language_scope_resolved' END) AS blockers
      FROM customer_indexes c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY run_date DESC) AS rn FROM quality_receipts WHERE run_date <= DATE '1998-01-01') WHERE rn = 1) q USING (index_code))""",
    ["customer_indexes", "quality_receipts"],
)
def audit_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.audit_readiness(
        _customer_indexes(spark, sf), _quality(spark, sf), F.lit(_RUN), F.lit(7), 60
    )
    return rows.withColumn("blockers", F.array_join("blockers", ","))


def _declared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = views.table(spark, sf, "orders").join(
        _customer_indexes(spark, sf), F.col("o_custkey") == F.col("c_custkey")
    )
    out = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    declared = orders.select("index_code", out.alias("output"), F.sha2("o_orderstatus", 256).alias("fingerprint"))
    actual = orders.filter(F.col("o_orderkey") % 97 != 0).select(
        "index_code",
        out.alias("output"),
        F.sha2(F.when(F.col("o_orderkey") % 89 == 0, "damaged").otherwise(F.col("o_orderstatus")), 256).alias("fingerprint"),
    )
    return declared, actual


views.SQL["verified"] = (
    ["customer_indexes"],
    "SELECT index_code, bool_and(o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0) AS verified, count(*) AS outputs FROM orders JOIN customer_indexes ON c_custkey = o_custkey GROUP BY 1",
)


@query(
    "output_verification",
    "J16 K3",
    "index_code:s verified:b outputs:i",
    "SELECT * FROM verified",
    ["verified"],
)
def output_verification(spark: SparkSession, sf: str) -> DataFrame:
    return gates.outputs_verified(*_declared(spark, sf))


@query(
    "cutover_gates",
    "J15 J16 A28 D15",
    "index_code:s state:s available_archive_days:i selected_constituents:i target_size:i blockers:s",
    f"""SELECT *, CASE WHEN blockers = '' THEN 'eligible_for_human_review' ELSE 'blocked' END AS state FROM (
      SELECT c.index_code, q.available_archive_days, q.selected_constituents, coalesce(q.target_size, c.target_size) AS target_size, concat_ws(',',
        CASE WHEN c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'archive_audit_passed' END,
        CASE WHEN NOT coalesce(c.c_custkey % 9 <> 0, false) THEN 'audit_index_ready' END, CASE WHEN q.index_code IS NULL THEN 'quality_receipt_available' END,
        CASE WHEN NOT coalesce(q.status = 'ready', false) THEN 'quality_status_ready' END, CASE WHEN NOT coalesce(q.available_archive_days >= q.required_lookback_days, false) THEN 'lookback_complete' END,
        CASE WHEN NOT coalesce(q.selected_constituents = q.target_size, false) THEN 'target_size_filled' END,
        CASE WHEN NOT coalesce(q.language_scope_status = c.language_scope_status AND c.language_scope_status <> '{LANGUAGE_PENDING}', false) THEN 'language_scope_resolved' END,
        CASE WHEN NOT coalesce(r.index_code IS NOT NULL AND r.status = 'ready' AND c.c_custkey % 10 <> 3, false) THEN 'calculation_manifest_matches' END,
        CASE WHEN NOT coalesce(v.verified, false) THEN 'calculation_outputs_verified' END) AS blockers
      FROM customer_indexes c LEFT JOIN (SELECT * FROM quality_receipts WHERE run_date = DATE '1998-01-01') q USING (index_code)
      LEFT JOIN receipts r ON r.index_code = c.index_code LEFT JOIN verified v ON v.index_code = c.index_code)""",
    ["customer_indexes", "quality_receipts", "receipts", "verified"],
)
def cutover_gates(spark: SparkSession, sf: str) -> DataFrame:
    # The audit of an index fails while one of its customer's orders is pending.
    open_orders = views.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    pending = open_orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("pending")).distinct()
    codes = _customer_indexes(spark, sf).join(pending, "c_custkey", "left")
    manifests = _receipts(spark, sf).select(
        "index_code",
        F.lit(_RUN).alias("generated_for"),
        "status",
        F.when(F.col("c_custkey") % 10 == 3, "1.2.0").otherwise("1.3.0").alias("methodology_version"),
    )
    audited = codes.select(
        "index_code", F.when(F.col("c_custkey") % 9 != 0, gates.ELIGIBLE).otherwise("accumulating").alias("state")
    )
    review = gates.cutover_review(
        codes,
        _quality(spark, sf),
        manifests,
        audited,
        gates.outputs_verified(*_declared(spark, sf)),
        ~F.coalesce(F.col("pending"), F.lit(False)),
        _RUN,
        views.METHOD,
    )
    # Map order is gate order, so the names compare as text.
    return review.withColumn("blockers", F.array_join("blockers", ","))


@query(
    "index_quality_rows",
    "A33 D8",
    "index_code:s status:s available_archive_days:i days_remaining_before_full_lookback:i target_size:i selected_constituents:i daily_values:i latest_analytics_date:s latest_rebalance:s",
    """SELECT d.index_code, CASE WHEN selected_constituents = d.target_size AND daily_values > 0 THEN 'ready' ELSE 'accumulating' END AS status, c.available_archive_days,
    greatest(60 - c.available_archive_days, 0) AS days_remaining_before_full_lookback, d.target_size, coalesce(selected_constituents, 0) AS selected_constituents, coalesce(daily_values, 0) AS daily_values, latest_analytics_date, latest_rebalance
    FROM definitions d LEFT JOIN (SELECT game_key, count(DISTINCT value_date) AS available_archive_days FROM archive_calendar GROUP BY 1) c USING (game_key)
    LEFT JOIN (SELECT index_code, max(effective_date) AS latest_rebalance, arg_max(n, effective_date) AS selected_constituents FROM (SELECT index_code, effective_date, count(*) AS n FROM basket GROUP BY 1, 2) GROUP BY 1) b USING (index_code)
    LEFT JOIN (SELECT index_code, count(*) AS daily_values, max(value_date) AS latest_analytics_date FROM daily_values GROUP BY 1) v USING (index_code)""",
    ["definitions", "archive_calendar", "basket", "daily_values"],
)
def index_quality_rows(spark: SparkSession, sf: str) -> DataFrame:
    return gates.quality_rows(
        views.definitions(spark),
        views.archive_calendar(spark, sf),
        views.basket(spark, sf),
        views.chain_tables(spark, sf)[0],
        date(2001, 8, 1),
        views.METHOD,
    )


# --- constraints ---------------------------------------------------------------------


def _interval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order-based lifecycle rows, some of them broken."""
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("index_code"),
        F.when(k % 17 != 0, F.col("o_custkey")).alias("cm_product_id"),
        F.lit("nonfoil").alias("variant_key"),
        F.when(k % 19 == 0, "").otherwise("name").alias("name"),
        F.lit("set").alias("set_name"),
        start.alias("member_since"),
        F.when(k % 5 == 0, start).when(k % 5 == 1, F.date_add(start, 30)).alias("removed_at"),
        F.when(k % 23 == 0, "paused").otherwise("added").alias("action"),
        F.when(k % 29 != 0, F.col("o_totalprice")).alias("liquidity_score"),
        F.col("o_totalprice").alias("ref_price"),
    )


@query(
    "interval_violations",
    "Q1",
    "index_code:s cm_product_id:i member_since:s violation:s",
    """SELECT o_orderpriority AS index_code, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS cm_product_id, CAST(o_orderdate AS DATE) AS member_since,
    unnest(list_filter([CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'identity' END, CASE WHEN o_orderkey % 23 = 0 THEN 'action' END,
      CASE WHEN o_orderkey % 5 = 0 THEN 'removal_after_start' END, CASE WHEN o_orderkey % 29 = 0 THEN 'metrics' END], lambda x: x IS NOT NULL)) AS violation FROM orders""",
)
def interval_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.interval_violations(_interval_rows(spark, sf))


@query(
    "provenance_violations",
    "Q2",
    "index_code:s violation:s",
    """SELECT index_code, unnest(list_filter([CASE WHEN f IS NULL AND status = 'published' THEN 'published_history_empty' END, CASE WHEN f IS NOT NULL AND f <> history_start_date THEN 'history_start_mismatch' END,
      CASE WHEN f IS NOT NULL AND NOT (base_date >= history_start_date AND coalesce(b, false)) THEN 'base_date_not_observed' END], lambda x: x IS NOT NULL)) AS violation
    FROM (SELECT d.*, f, b FROM (SELECT index_code, status, history_start_date, base_date FROM history_definitions UNION ALL SELECT c_name, 'published', DATE '1995-01-01', DATE '1995-01-10' FROM customer WHERE c_custkey % 100 = 0) d
      LEFT JOIN (SELECT index_code, min(value_date) AS f, bool_or(value_date = DATE '1995-01-10') AS b FROM history GROUP BY 1) h USING (index_code))""",
    ["history_definitions", "history"],
)
def provenance_violations(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["index_code", "status", "history_start_date", "base_date"]
    extra = views.table(spark, sf, "customer").filter(F.col("c_custkey") % 100 == 0).select(
        F.col("c_name").alias("index_code"),
        F.lit("published").alias("status"),
        F.lit(date(1995, 1, 1)).alias("history_start_date"),
        F.lit(date(1995, 1, 10)).alias("base_date"),
    )
    defs = views.history_definitions(spark, sf).select(*cols).unionByName(extra)
    return quality.provenance_violations(defs, views.history(spark, sf))


@query(
    "rebalance_contract_violations",
    "Q3 J20",
    "index_code:s effective_date:s violation:s",
    """SELECT index_code, effective_date, unnest(list_filter([CASE WHEN month(effective_date) = 7 THEN 'active_count' END, CASE WHEN month(effective_date) IN (5, 6) THEN 'retained_count' END], lambda x: x IS NOT NULL)) AS violation FROM derived""",
    ["derived"],
)
def rebalance_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    intervals = views.intervals(spark, sf)
    month = F.month("effective_date")
    records = (
        membership.derived_rebalances(intervals)
        .withColumn("active_count", F.col("active_count") + F.when(month == 7, 1).otherwise(0))
        .withColumn("retained_count", F.col("retained_count") + F.when(month.isin(5, 6), 2).otherwise(0))
    )
    return quality.rebalance_contract_violations(records, intervals)


@query(
    "unreconciled_changes",
    "J26",
    "index_code:s effective_date:s cm_product_id:i variant_key:s action:s",
    """SELECT index_code, effective_date + 3 AS effective_date, cm_product_id, variant_key, action FROM changes WHERE month(effective_date) = 4""",
    ["changes"],
)
def unreconciled_changes(spark: SparkSession, sf: str) -> DataFrame:
    removed = views.basket_removed(spark, sf)
    intervals = membership.lifecycle(views.basket(spark, sf), removed)
    day = F.col("effective_date")
    shifted = membership.rebalance_changes(intervals, removed).withColumn(
        "effective_date", F.when(F.month(day) == 4, F.date_add(day, 3)).otherwise(day)
    )
    return quality.change_violations(shifted, intervals)


@query(
    "duplicate_constituents",
    "Q4 A12",
    "index_code:s cm_product_id:i member_since:s n:i",
    """SELECT o_orderpriority AS index_code, o_custkey AS cm_product_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS member_since, count(*) AS n FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def duplicate_constituents(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("index_code"),
        F.col("o_custkey").alias("cm_product_id"),
        F.trunc("o_orderdate", "MM").alias("member_since"),
    )
    return quality.unique_violations(rows, ["index_code", "cm_product_id", "member_since"])


@query(
    "exposure_violations",
    "Q5",
    "index_code:s violation:s",
    """SELECT index_code, CASE WHEN status = 'published' THEN 'published_without_data' ELSE 'unpublished_with_data' END AS violation
    FROM (SELECT d.index_code, d.status, coalesce(h.n, 0) AS h, coalesce(c.n, 0) AS c FROM definitions d LEFT JOIN (SELECT index_code, count(*) AS n FROM daily_values WHERE index_code <> 'ONS8' GROUP BY 1) h USING (index_code)
      LEFT JOIN (SELECT index_code, count(*) AS n FROM intervals GROUP BY 1) c USING (index_code)) WHERE (status = 'published' AND (h = 0 OR c = 0)) OR (status <> 'published' AND (h > 0 OR c > 0))""",
    ["definitions", "daily_values", "intervals"],
)
def exposure_violations(spark: SparkSession, sf: str) -> DataFrame:
    values = views.chain_tables(spark, sf)[0].filter(F.col("index_code") != "ONS8")
    return quality.exposure_violations(views.definitions(spark), values, views.intervals(spark, sf))


def _published_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = views.table(spark, sf, "documents")
    d = F.col("doc_id")
    path = F.concat(F.lit("data/"), d.cast("string"), F.lit(".json"))
    declared = docs.select(path.alias("path"), F.sha2("text", 256).alias("checksum"))
    body = F.when(d % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = docs.filter(d % 14 != 0).select(
        path.alias("path"), F.sha2(body, 256).alias("checksum"), (F.octet_length("text") * 20).alias("bytes")
    )
    return declared, actual


@query(
    "file_violations",
    "Q6 S9 F15",
    "path:s violation:s",
    """SELECT 'data/' || doc_id || '.json' AS path, unnest(list_filter([CASE WHEN doc_id % 14 = 0 OR doc_id % 10 = 0 THEN 'checksum_mismatch' END,
      CASE WHEN doc_id % 14 <> 0 AND strlen(text) * 20 > 1000000 THEN 'exceeds_hard_limit' END, CASE WHEN doc_id % 14 <> 0 AND strlen(text) * 20 > 250000 THEN 'exceeds_preferred_size' END], lambda x: x IS NOT NULL)) AS violation FROM documents""",
)
def file_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.file_violations(*_published_files(spark, sf))


@query(
    "build_size_stats",
    "A31",
    "file_count:i total_bytes:i largest_path:s largest_bytes:i over_hard:i over_preferred:i",
    """SELECT count(*) AS file_count, sum(b) AS total_bytes, (list(path ORDER BY b DESC, path))[1] AS largest_path, max(b) AS largest_bytes, count(*) FILTER (b > 1000000) AS over_hard, count(*) FILTER (b > 250000) AS over_preferred
    FROM (SELECT 'data/' || doc_id || '.json' AS path, strlen(text) * 20 AS b FROM documents WHERE doc_id % 14 <> 0)""",
)
def build_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.build_size_stats(_published_files(spark, sf)[1])


@query(
    "status_violations",
    "Q7",
    "violation:s",
    """WITH days AS (SELECT index_code, value_date, lag(value_date) OVER (PARTITION BY index_code ORDER BY value_date) AS before FROM history),
    found AS (SELECT index_code, coalesce(sum(value_date - before - 1), 0) AS gap_count, max(value_date) AS last_calc_date, count(*) AS version FROM days GROUP BY 1),
    stated AS (SELECT o_orderpriority AS index_code, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS last_calc_date,
      count(DISTINCT CAST(o_orderdate AS DATE)) AS version, max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) + 1 - count(DISTINCT CAST(o_orderdate AS DATE)) AS gap_count FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1)
    SELECT f.index_code || ':' || name AS violation FROM found f JOIN stated s USING (index_code),
    (VALUES ('gap_count'), ('last_calc_date'), ('dataset_version')) c(name)
    WHERE CASE name WHEN 'gap_count' THEN f.gap_count IS DISTINCT FROM s.gap_count WHEN 'last_calc_date' THEN f.last_calc_date IS DISTINCT FROM s.last_calc_date ELSE f.version IS DISTINCT FROM s.version END""",
    ["history"],
)
def status_violations(spark: SparkSession, sf: str) -> DataFrame:
    # Each index states what the orders of some customers say; its history says otherwise.
    def facts(days: DataFrame, last: F.Column) -> DataFrame:
        span = F.date_diff(F.max("value_date"), F.min("value_date")) + 1
        return days.groupBy("index_code").agg(
            (span - F.count_distinct("value_date")).cast("bigint").alias("gap_count"),
            last.alias("last_calc_date"),
            F.count_distinct("value_date").cast("string").alias("dataset_version"),
        )

    expected = facts(views.history(spark, sf), F.max("value_date"))
    some = views.table(spark, sf, "orders").filter(F.col("o_custkey") % 7 != 0)
    orders = some.select(F.col("o_orderpriority").alias("index_code"), F.to_date("o_orderdate").alias("value_date"), "o_orderstatus")
    stated = facts(orders, F.max(F.when(F.col("o_orderstatus") == "F", F.col("value_date"))))
    found = quality.status_violations(stated, expected, ["index_code"])
    return found.select(F.concat_ws(":", "index_code", "violation").alias("violation"))


@query(
    "orphan_lines",
    "Q8",
    "l_orderkey:i l_linenumber:i l_partkey:i",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)",
)
def orphan_lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = views.table(spark, sf, "part").filter(F.col("p_size") > 3)
    return quality.fk_violations(views.table(spark, sf, "lineitem"), parts, ["l_partkey"], ["p_partkey"])


@query(
    "thin_orders",
    "Q8",
    "l_orderkey:i n:i",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 3",
)
def thin_orders(spark: SparkSession, sf: str) -> DataFrame:
    return quality.threshold_violations(views.table(spark, sf, "lineitem"), ["l_orderkey"], 3)


@query(
    "link_violations",
    "Q8",
    "kind:s node:i",
    """SELECT 'self' AS kind, o_orderkey AS node FROM orders WHERE o_orderkey = o_custkey
    UNION ALL SELECT 'orphan', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def link_violations(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders")
    selfish = quality.self_link_violations(orders, "o_orderkey", "o_custkey").select(
        F.lit("self").alias("kind"), F.col("o_orderkey").alias("node")
    )
    links = orders.select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "O", "parent").otherwise("related").alias("type"))
    nodes = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    lonely = quality.orphans(nodes, links, "node", "source").select(F.lit("orphan").alias("kind"), "node")
    return selfish.unionByName(lonely)


@query(
    "append_only_violations",
    "Q9",
    "o_orderkey:i violation:s",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'deleted' ELSE 'updated' END AS violation FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0""",
)
def append_only_violations(spark: SparkSession, sf: str) -> DataFrame:
    old = views.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    new = old.filter(k % 101 != 0).withColumn(
        "o_totalprice", F.when(k % 103 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return merge.append_only_violations(old, new, ["o_orderkey"])


@query(
    "product_violations",
    "Q10",
    "game_key:s cm_product_id:i violation:s",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, p_partkey AS cm_product_id,
    unnest(list_filter([CASE WHEN p_type = 'PROMO' THEN 'product_kind' END, CASE WHEN p_size = 5 THEN 'name' END, CASE WHEN p_size > 40 THEN 'seen_order' END], lambda x: x IS NOT NULL)) AS violation FROM part""",
)
def product_violations(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.col("p_partkey")
    rows = views.table(spark, sf, "part").select(
        views.part_game(pid).alias("game_key"),
        pid.alias("cm_product_id"),
        F.when(F.col("p_type") == "PROMO", "promo").otherwise("single").alias("product_kind"),
        F.when(F.col("p_size") == 5, "").otherwise(F.col("p_name")).alias("name"),
        F.lit(date(2000, 1, 1)).alias("first_seen"),
        F.when(F.col("p_size") > 40, F.lit(date(1999, 1, 1))).otherwise(F.lit(date(2000, 1, 1))).alias("last_seen"),
    )
    return quality.product_violations(rows)


@query(
    "definition_violations",
    "Q10 S5",
    "index_code:s violation:s",
    """SELECT c_name AS index_code, unnest(list_filter([CASE WHEN c_mktsegment = 'MACHINERY' THEN 'universe' END, CASE WHEN c_custkey % 7 = 0 THEN 'status' END, CASE WHEN c_custkey % 11 = 0 THEN 'target_size' END], lambda x: x IS NOT NULL)) AS violation FROM customer""",
)
def definition_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = views.table(spark, sf, "customer").select(
        F.col("c_name").alias("index_code"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "all").otherwise("sealed").alias("universe"),
        F.when(k % 7 == 0, "live").otherwise("draft").alias("status"),
        (k % 11).alias("target_size"),
    )
    return quality.definition_violations(rows)


@query(
    "contract_violations",
    "Q11",
    "key:s violation:s",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice > 450000 THEN 'coverage_range' END, CASE WHEN o_custkey % 4 <> 1 AND o_custkey % 4 <> 2 THEN 'gap_count' END], lambda x: x IS NOT NULL)) AS violation FROM orders""",
)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.when(F.col("o_orderstatus") == "P", "ill").otherwise("healthy").alias("status"),
        (F.col("o_totalprice") / 450000).alias("coverage_ratio"),
        F.when(F.col("o_custkey") % 4 != 2, F.col("o_custkey") % 4).alias("gap_count"),
        F.array(F.lit("2000-01-01")).alias("gaps"),
    )
    return quality.health_violations(rows)


@query(
    "readiness_contract_violations",
    "Q11",
    "index_code:s violation:s",
    "SELECT index_code, 'state' AS violation FROM receipts WHERE status = 'accumulating' AND c_custkey % 8 = 0",
    ["receipts"],
)
def readiness_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _receipts(spark, sf).select(
        "index_code",
        F.when((F.col("status") == "accumulating") & (F.col("c_custkey") % 8 == 0), "done").otherwise("accumulating").alias("state"),
        "required_days",
        F.lit(8).alias("target_size"),
        F.array(F.lit("lookback_complete")).alias("blockers"),
    )
    return quality.readiness_violations(rows)


@query(
    "universe_coverage",
    "Q12",
    "game_key:s singles:i sealed:i complete:b",
    """SELECT c_name AS game_key, count(*) FILTER (o_orderstatus = 'O') AS singles, count(*) FILTER (o_orderstatus = 'F') AS sealed,
    count(*) FILTER (o_orderstatus = 'O') = 1 AND count(*) FILTER (o_orderstatus = 'F') = 1 AS complete FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def universe_coverage(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = views.table(spark, sf, "orders").join(
        views.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("c_name").alias("game_key"),
        F.when(status == "O", "singles").when(status == "F", "sealed").otherwise("none").alias("universe"),
    )
    return quality.universe_coverage(rows)


@query(
    "history_violations",
    "W14",
    "index_code:s value_date:s violation:s",
    """SELECT index_code, value_date, unnest(list_filter([CASE WHEN abs(daily_return) > 0.25 THEN 'return_above_cap' END, CASE WHEN day(value_date) = 9 AND before IS NOT NULL THEN 'return_mismatch' END], lambda x: x IS NOT NULL)) AS violation
    FROM (SELECT index_code, value_date, CASE WHEN day(value_date) = 9 THEN daily_return + 0.001 ELSE daily_return END AS daily_return, lag(value_date) OVER (PARTITION BY index_code ORDER BY value_date) AS before FROM history)""",
    ["history"],
)
def history_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.history(spark, sf)
    shifted = F.when(F.dayofmonth("value_date") == 9, F.col("daily_return") + 0.001).otherwise(F.col("daily_return"))
    return quality.history_violations(rows.withColumn("daily_return", shifted))


@query(
    "rebalance_order_violations",
    "W15",
    "index_code:s effective_date:s violation:s",
    """SELECT o_orderpriority AS index_code, CAST(o_orderdate AS DATE) AS effective_date, 'date_not_unique' AS violation FROM orders GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT o_orderpriority, max(CAST(o_orderdate AS DATE)), 'generated_for_mismatch' FROM orders GROUP BY 1 HAVING max(CAST(o_orderdate AS DATE)) <> DATE '2001-08-01'""",
)
def rebalance_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("index_code"), F.to_date("o_orderdate").alias("effective_date")
    )
    generated = views.history_definitions(spark, sf).select("index_code", F.lit(date(2001, 8, 1)).alias("generated_for"))
    return quality.rebalance_order_violations(rows, generated)


@query(
    "contribution_invariants",
    "D3 A3",
    "index_code:s value_date:s violation:s",
    """WITH c AS (SELECT *, CASE WHEN day(value_date) = 5 THEN contribution + 0.5 ELSE contribution END AS wrong, CASE WHEN day(value_date) = 6 THEN used_return + 9 ELSE used_return END AS beyond
      FROM contributions WHERE NOT (day(value_date) = 7 AND cm_product_id % 2 = 0)),
    s AS (SELECT index_code, value_date, sum(wrong) AS total, max(abs(beyond)) AS largest, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT v.index_code, v.value_date, name AS violation FROM daily_values v LEFT JOIN s USING (index_code, value_date), (VALUES ('sum_of_contributions'), ('cap'), ('active_rows')) k(name)
    WHERE NOT coalesce(CASE name WHEN 'sum_of_contributions' THEN abs(total - daily_return) <= 1e-12 WHEN 'cap' THEN largest <= 0.25 ELSE n = n_constituents_active END, false)""",
    ["daily_values", "contributions"],
)
def contribution_invariants(spark: SparkSession, sf: str) -> DataFrame:
    # On three days of each month the contributions are spoiled, each in another way.
    values, contributions = views.chain_tables(spark, sf)
    day = F.dayofmonth("value_date")
    contributions = (
        contributions.filter(~((day == 7) & (F.col("cm_product_id") % 2 == 0)))
        .withColumn("contribution", F.when(day == 5, F.col("contribution") + 0.5).otherwise(F.col("contribution")))
        .withColumn("used_return", F.when(day == 6, F.col("used_return") + 9).otherwise(F.col("used_return")))
    )
    return quality.contribution_invariants(values, contributions, views.METHOD.daily_return_cap)


# --- sinks ---------------------------------------------------------------------------


@query(
    "sorted_table_write",
    "K1 T6 S4",
    "game_key:s cm_product_id:i variant_key:s value_date:s price_avg:f8 price_low:f8",
    "SELECT * FROM price_panel",
    ["price_panel"],
)
def sorted_table_write(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.sources.tables import read_catalogue

    path = views.scratch(spark)
    rows = stream_prices.price_rows(views.price_panel(spark, sf))
    tables.write_sorted(rows, path, PRICES, ["cm_product_id", "variant_key", "value_date"], ["game_key"])
    return read_catalogue(spark, path, PRICES, required=True)


@query(
    "write_receipts",
    "K2 K3 K9",
    "attempt:i rows:i changed:b same_fingerprint:b",
    """SELECT 1 AS attempt, count(*) AS rows, true AS changed, true AS same_fingerprint FROM price_panel UNION ALL SELECT 2, count(*), false, true FROM price_panel
    UNION ALL SELECT 3, count(*), true, false FROM price_panel WHERE price_avg IS NOT NULL""",
    ["price_panel"],
)
def write_receipts(spark: SparkSession, sf: str) -> DataFrame:
    path = views.scratch(spark)
    rows = stream_prices.price_rows(views.price_panel(spark, sf))
    order = ["game_key", "cm_product_id", "variant_key", "value_date"]
    receipts = [
        tables.write_if_changed(rows, path, PRICES, order),
        tables.write_if_changed(rows, path, PRICES, order),
        tables.write_if_changed(rows.filter(F.col("price_avg").isNotNull()), path, PRICES, order),
    ]
    first = receipts[0].fingerprint
    frame = tables.receipts_frame(spark, receipts)
    number = F.row_number()
    from pyspark.sql import Window

    # Three receipts.
    return frame.withColumn("same_fingerprint", F.col("fingerprint") == first).withColumn(
        "attempt", number.over(Window.orderBy(F.desc("same_fingerprint"), F.desc("changed")))
    )


@query(
    "keyed_upsert",
    "K7",
    "o_orderkey:i o_totalprice:f2 o_orderstatus:s",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders
    UNION ALL SELECT o_orderkey + 1000000000, o_totalprice * 2, 'U' FROM orders WHERE o_orderkey % 3 = 1""",
)
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.sinks.versions import VersionedTable, upsert_keys

    k = F.col("o_orderkey")
    shape = struct("o_orderkey bigint, o_totalprice double, o_orderstatus string, bucket int")
    table = VersionedTable(spark, views.scratch(spark), shape, ["bucket"], ["o_orderkey"])
    old = views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    upsert_keys(table, old, ["o_orderkey"], 16)
    incoming = old.filter(k % 3 != 2).select(
        F.when(k % 3 == 1, k + 1000000000).otherwise(k).alias("o_orderkey"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"),
        F.lit("U").alias("o_orderstatus"),
    )
    upsert_keys(table, incoming, ["o_orderkey"], 16)
    return table.read()


@query(
    "interrupted_write",
    "K1 K2 ST2",
    "state:s game_key:s rows:i total:f2",
    """SELECT 'during' AS state, game_key, count(*) AS rows, sum(price_low) AS total FROM price_panel GROUP BY 2
    UNION ALL SELECT 'after', game_key, count(*), sum(CASE WHEN year(value_date) = 1999 THEN price_low * 2 ELSE price_low END) FROM price_panel GROUP BY 2""",
    ["price_panel"],
)
def interrupted_write(spark: SparkSession, sf: str) -> DataFrame:
    """A merge that dies between writing and the switch leaves the old rows; its repetition gives the new."""
    from pricetide.plans.daily import merge_price_partitions
    from pricetide.schemas import PRICE_TABLE
    from pricetide.session import cut_lineage
    from pricetide.sinks.versions import VersionedTable

    class Lost(Exception):
        pass

    class Dying(VersionedTable):
        def _commit(self, *_: object) -> None:
            raise Lost

    path = views.scratch(spark)
    panel = stream_prices.price_rows(views.price_panel(spark, sf))
    merge_price_partitions(spark, path, panel)
    replay = panel.filter(F.year("value_date") == 1999).withColumn("price_low", F.col("price_low") * 2)
    try:
        month = F.date_format("value_date", "yyyy-MM")
        Dying(spark, path, PRICE_TABLE, ["game_key", "month"], ["value_date"]).replace_partitions(replay.withColumn("month", month))
    except Lost:
        pass

    def totals(state: str) -> DataFrame:
        rows = tables.read_stored(spark, path).groupBy("game_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("price_low").alias("total"))
        return rows.withColumn("state", F.lit(state))

    during = cut_lineage(totals("during"))
    merge_price_partitions(spark, path, replay)
    return during.unionByName(totals("after"))


@query(
    "json_export",
    "K5 K8 S8",
    "index_code:s value_date:s index_value:f2 calc_version:s",
    "SELECT * FROM history WHERE index_code IN (SELECT index_code FROM history_definitions WHERE status = 'published' AND history_start_kind = 'published')",
    ["history", "history_definitions"],
)
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.schemas import HISTORY

    path = views.scratch(spark)
    shown = exports.visible_rows(views.history(spark, sf), views.history_definitions(spark, sf))
    exports.write_json(shown, path, ["index_code"])
    return spark.read.schema(HISTORY).json(path)


@query(
    "csv_export",
    "K6",
    "index_code:s value_date:s index_value:s n_capped:s",
    """SELECT index_code, value_date, printf('%.6f', index_value) AS index_value, coalesce(n_capped, 0) AS n_capped FROM history WHERE index_code IN (SELECT index_code FROM history_definitions WHERE status = 'published')""",
    ["history", "history_definitions"],
)
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    path = views.scratch(spark)
    exports.write_history_csv(views.history(spark, sf), views.history_definitions(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in [*exports.CSV_COLUMNS, "index_code"])
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    "run_receipts",
    "K10 A32",
    "run_date:s game_key:s rows:i status:s",
    """SELECT run_date, game_key, sum(records) * CASE WHEN month(run_date) % 2 = 0 THEN 10 ELSE 1 END AS rows, CASE WHEN month(run_date) % 2 = 0 THEN 'again' ELSE 'ok' END AS status FROM manifest_files GROUP BY 1, 2""",
    ["manifest_files"],
)
def run_receipts(spark: SparkSession, sf: str) -> DataFrame:
    path = views.scratch(spark)
    day = ["run_date", "game_key"]
    notes = views.manifest_files(spark, sf).groupBy(*day).agg(F.sum("records").alias("rows"), F.max(F.lit("ok")).alias("status"))
    tables.append_receipts(spark, path, notes, day)
    again = notes.filter(F.month("run_date") % 2 == 0).withColumn("rows", F.col("rows") * 10).withColumn("status", F.lit("again"))
    return tables.append_receipts(spark, path, again, day)


@query(
    "dataset_manifest",
    "K9",
    "dataset_version:s output:s fingerprint:s",
    "SELECT 'v1' AS dataset_version, doc_id AS output, sha256(text) AS fingerprint FROM documents",
)
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    receipts = views.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("output"), F.sha2("text", 256).alias("fingerprint")
    )
    return tables.dataset_manifest(receipts, "v1")


@query(
    "cutover_bundle",
    "K11 D15",
    "attempt:s written:b bundle:s index_code:s rows:i total:f2 open_gates:i",
    """WITH bundle AS (
      SELECT 'history' AS bundle, index_code, count(*) AS rows, sum(index_value) AS total FROM daily_values GROUP BY 2
      UNION ALL SELECT 'constituents', index_code, count(*), sum(ref_price) FROM intervals GROUP BY 2
      UNION ALL SELECT 'rebalances', index_code, count(*), sum(members) FROM (SELECT index_code, effective_date, count(*) AS members FROM basket GROUP BY 1, 2) GROUP BY 2
      UNION ALL SELECT 'analytics', index_code, count(*), sum(index_value) FROM daily_values WHERE day(value_date) = 1 GROUP BY 2
      UNION ALL SELECT 'metadata', index_code, 1, target_size FROM definitions)
    SELECT 'blocked' AS attempt, false AS written, 'review' AS bundle, index_code, 1 AS rows, NULL AS total, CASE WHEN status = 'published' THEN 0 ELSE 1 END AS open_gates FROM definitions
    UNION ALL SELECT 'eligible', true, bundle, index_code, rows, total, 0 FROM bundle WHERE index_code IN (SELECT index_code FROM definitions WHERE status = 'published')""",
    ["daily_values", "intervals", "basket", "definitions"],
)
def cutover_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of all indexes, of which some are unpublished, is held back; that of the published ones is written."""
    from pricetide.plans.indexes import write_candidate
    from pricetide.session import cut_lineage

    definitions = views.definitions(spark)
    values = cut_lineage(views.chain_tables(spark, sf)[0])
    members = views.basket(spark, sf).groupBy("index_code", "effective_date").agg(F.count(F.lit(1)).alias("total"))
    tables_ = {
        "history": values.withColumn("total", F.col("index_value")),
        "constituents": views.intervals(spark, sf).withColumn("total", F.col("ref_price")),
        "rebalances": members,
        "analytics": values.filter(F.dayofmonth("value_date") == 1).withColumn("total", F.col("index_value")),
        "metadata": definitions.withColumn("total", F.col("target_size")),
    }
    published = F.col("status") == "published"
    gate = F.create_map(F.lit("published"), published).alias("gates")
    review = definitions.select("index_code", F.when(published, gates.ELIGIBLE).otherwise("blocked").alias("state"), gate)
    held, done = views.scratch(spark), views.scratch(spark)
    flags = {
        "blocked": write_candidate(review, *tables_.values(), held),
        "eligible": write_candidate(
            review.join(definitions.filter(published), "index_code", "left_semi"),
            *(t.join(definitions.filter(published).select("index_code"), "index_code", "left_semi") for t in tables_.values()),
            done,
        ),
    }
    seen = F.from_json("gates", "map<string,boolean>")
    out = spark.read.json(f"{held}/review").select(
        F.lit("review").alias("bundle"),
        "index_code",
        F.lit(1).alias("rows"),
        F.lit(None).cast("double").alias("total"),
        F.size(F.filter(F.map_values(seen), lambda ok: ~ok)).alias("open_gates"),
        F.lit("blocked").alias("attempt"),
    )
    for name in tables_:
        stored = spark.read.json(f"{done}/candidate/{name}")
        rows = stored.groupBy("index_code").agg(F.count(F.lit(1)).alias("rows"), F.sum("total").cast("double").alias("total"))
        out = out.unionByName(
            rows.withColumns({"bundle": F.lit(name), "open_gates": F.lit(0), "attempt": F.lit("eligible")})
        )
    return out.withColumn("written", F.when(F.col("attempt") == "blocked", F.lit(flags["blocked"])).otherwise(F.lit(flags["eligible"])))


# --- incremental forms ---------------------------------------------------------------

_LIMITED = """SELECT user_id, event_id, ms, requests_in_window, requests_in_window > 2 AS limited FROM (
    SELECT user_id, event_id, ms, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id) AS requests_in_window
    FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events))"""


@query(
    "request_limits",
    "W16 ST4",
    "user_id:i event_id:i requests_in_window:i limited:b",
    _LIMITED,
)
def request_limits(spark: SparkSession, sf: str) -> DataFrame:
    events = requests.millis(views.table(spark, sf, "events"))
    return requests.rate_limited(events, "user_id", "event_id", limit=2, window_ms=3_600_000)


@query(
    "request_limits_stream",
    "ST4",
    "user_id:i event_id:i requests_in_window:i limited:b",
    _LIMITED,
)
def request_limits_stream(spark: SparkSession, sf: str) -> DataFrame:
    source, root = views.scratch(spark), views.scratch(spark)
    events = requests.millis(views.table(spark, sf, "events")).select("user_id", "event_id", "ms")
    # Two arrivals: the stream runs once after each and goes on where it stopped.
    middle = F.lit(1_705_000_000_000)
    for arrival in (F.col("ms") < middle, F.col("ms") >= middle):
        events.filter(arrival).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        requests.start_rate_limit(
            spark, stream, "user_id", "event_id", root, limit=2, window_ms=3_600_000
        ).awaitTermination()
    return spark.read.parquet(f"{root}/verdicts")


@query(
    "member_flags_stream",
    "ST3 W2 W3",
    "index_code:s value_date:s cm_product_id:i variant_key:s used_return:f8 flag:s",
    "SELECT * FROM flagged",
    ["flagged"],
)
def member_flags_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The panel in two arrivals: some days come late, and some rows come twice."""
    source, root = views.scratch(spark), views.scratch(spark)
    panel = chain.member_panel(
        views.price_panel(spark, sf),
        views.basket(spark, sf),
        views.archive_calendar(spark, sf),
        views.definitions(spark),
        views.METHOD,
    )
    panel = cut_lineage(panel)
    flags = stream_prices.MemberFlags(spark, views.METHOD, root, delay_days=20)
    day, middle = F.col("value_date"), F.lit("1996-06-15").cast("date")
    first = (day < F.date_sub(middle, 15)) | ((day < middle) & (F.dayofmonth(day) % 3 != 0))
    again = (day < middle) & (day > F.date_sub(middle, 40))
    for arrival in (first, ~first | again):
        panel.filter(arrival).write.mode("append").parquet(source)
        flags.start(spark.readStream.schema(panel.schema).parquet(source)).awaitTermination()
    flags.close(panel.schema)
    return flags.flags()


@query(
    "price_merge_stream",
    "ST2 A14 S3",
    "cm_product_id:i variant_key:s value_date:s price_avg:f8",
    """SELECT cm_product_id, variant_key, value_date, CASE WHEN year(value_date) = 1999 THEN price_avg * 2 ELSE price_avg END AS price_avg FROM price_panel""",
    ["price_panel"],
)
def price_merge_stream(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.plans.daily import merge_price_partitions
    from pricetide.schemas import PRICE_TABLE

    source, path, checkpoint = views.scratch(spark), views.scratch(spark), views.scratch(spark)
    panel = stream_prices.price_rows(views.price_panel(spark, sf))
    merge_price_partitions(spark, path, panel)
    # A replayed year arrives as a stream and replaces its days.
    replay = panel.filter(F.year("value_date") == 1999).withColumn("price_avg", F.col("price_avg") * 2)
    replay.write.parquet(source)
    stream = spark.readStream.schema(PRICES).parquet(source)
    stream_prices.start_price_merge(spark, stream, path, checkpoint).awaitTermination()
    return tables.stored(spark, path, PRICE_TABLE)
