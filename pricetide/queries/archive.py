"""Archive, manifest and audit queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import ids
from pricetide.operators import archive
from pricetide.params import literal_table
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.schemas import struct
from pricetide.sources import manifests as manifest_source

_START, _END = date(1995, 1, 1), date(2001, 12, 31)
views.SQL["days"] = (
    [],
    "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS run_date",
)
views.SQL["inceptions"] = (
    [],
    "SELECT * FROM (VALUES ('onepiece', DATE '1995-01-01'), ('pokemon', DATE '1995-06-15')) i(game_key, inception)",
)
views.SQL["expected_entries"] = (
    ["days", "inceptions"],
    "SELECT run_date, game_key, kind FROM days JOIN inceptions ON run_date >= inception, (VALUES ('priceguide'), ('catalogue')) k(kind)",
)


def _days(spark: SparkSession) -> DataFrame:
    return archive.calendar_days(spark.range(1), F.lit(_START), F.lit(_END))


def _inceptions(spark: SparkSession) -> DataFrame:
    rows = [("onepiece", date(1995, 1, 1)), ("pokemon", date(1995, 6, 15))]
    return literal_table(spark, rows, struct("game_key string, inception date"))


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    """An object listing with one key per order."""
    n = F.col("o_orderkey") % 7
    prefix = (
        F.when(n == 0, "cardmarket/priceguide/")
        .when(n == 1, "manifests/")
        .when(n == 2, "derived/catalogue/")
        .when(n == 3, "derived/prices/")
        .when(n == 4, "derived/indexes/")
        .when(n == 5, "derived/calc_runs/")
        .otherwise("tmp/")
    )
    return views.table(spark, sf, "orders").select(
        F.concat(prefix, F.col("o_orderkey").cast("string")).alias("key"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
    )


views.SQL["objects"] = (
    [],
    """SELECT CASE o_orderkey % 7 WHEN 0 THEN 'cardmarket/priceguide/' WHEN 1 THEN 'manifests/' WHEN 2 THEN 'derived/catalogue/' WHEN 3 THEN 'derived/prices/'
    WHEN 4 THEN 'derived/indexes/' WHEN 5 THEN 'derived/calc_runs/' ELSE 'tmp/' END || o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 7 AS n FROM orders""",
)


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests per order day: some malformed, some naming another day."""
    day = F.col("path_date")
    days = views.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("path_date")).distinct()
    return days.select(
        day,
        F.when(F.dayofmonth(day) == 20, F.date_add(day, 1)).otherwise(day).cast("string").alias("run_date"),
        (F.dayofmonth(day) == 21).alias("malformed"),
    )


views.SQL["manifests"] = (
    [],
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS path_date, day(o_orderdate) = 21 AS malformed, day(o_orderdate) = 20 AS misdated FROM orders""",
)


@query(
    "unchanged_snapshots",
    "J13 F15",
    "run_date:s game_key:s kind:s sha256:s unchanged:b",
    """SELECT a.run_date, a.game_key, a.kind, a.sha256, coalesce(a.sha256 = b.sha256, false) AS unchanged FROM manifest_files a
    LEFT JOIN manifest_files b ON b.game_key = a.game_key AND b.kind = a.kind AND b.run_date + 1 = a.run_date""",
    ["manifest_files"],
)
def unchanged_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return archive.unchanged_from_previous(views.manifest_files(spark, sf))


@query(
    "archive_calendar",
    "S10 S2",
    "game_key:s value_date:s unchanged:b",
    """SELECT game_key, run_date AS value_date, bool_or(unchanged) AS unchanged FROM (
      SELECT a.*, coalesce(a.sha256 = b.sha256, false) AS unchanged FROM manifest_files a
      LEFT JOIN manifest_files b ON b.game_key = a.game_key AND b.kind = a.kind AND b.run_date + 1 = a.run_date)
    WHERE kind = 'priceguide' AND run_date <= DATE '2000-06-30' AND game_key = 'onepiece' GROUP BY 1, 2
    UNION ALL SELECT DISTINCT game_key, value_date, false FROM price_panel WHERE game_key = 'pokemon' AND value_date <= DATE '2000-06-30'""",
    ["manifest_files", "price_panel"],
)
def archive_calendar(spark: SparkSession, sf: str) -> DataFrame:
    # Only one game has manifests here, so the other falls back to its price days.
    files = archive.unchanged_from_previous(views.manifest_files(spark, sf)).filter(F.col("game_key") == "onepiece")
    text_dates = files.withColumn("run_date", F.col("run_date").cast("string"))
    return manifest_source.archive_calendar(text_dates, views.price_panel(spark, sf), date(2000, 6, 30))


@query(
    "missing_manifest_days",
    "J10 F9",
    "run_date:s key:s",
    """SELECT run_date, 'manifests/' || run_date || '.json' AS key FROM days WHERE run_date NOT IN (SELECT run_date FROM manifest_files)""",
    ["days", "manifest_files"],
)
def missing_manifest_days(spark: SparkSession, sf: str) -> DataFrame:
    gaps = archive.missing_days(_days(spark), views.manifest_files(spark, sf))
    return gaps.withColumn("key", ids.manifest_key(F.col("run_date")))


@query(
    "missing_manifest_entries",
    "J11 J22",
    "run_date:s game_key:s kind:s",
    "SELECT run_date, game_key, kind FROM expected_entries EXCEPT SELECT run_date, game_key, kind FROM manifest_files",
    ["expected_entries", "manifest_files"],
)
def missing_manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    expected = archive.expected_entries(_days(spark), _inceptions(spark))
    return archive.missing_entries(expected, views.manifest_files(spark, sf)).select("run_date", "game_key", "kind")


@query(
    "unexpected_manifest_entries",
    "J11 J22",
    "run_date:s game_key:s kind:s",
    "SELECT run_date, game_key, kind FROM manifest_files EXCEPT SELECT run_date, game_key, kind FROM expected_entries",
    ["expected_entries", "manifest_files"],
)
def unexpected_manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    expected = archive.expected_entries(_days(spark), _inceptions(spark))
    return archive.unexpected_entries(expected, views.manifest_files(spark, sf))


@query(
    "manifest_structure_errors",
    "D11 F5 F6",
    "run_date:s game_key:s kind:s key:s error:s",
    """SELECT run_date, game_key, kind, key, 'unsupported schema_version' AS error FROM manifest_files WHERE schema_version <> 1
    UNION ALL SELECT run_date, game_key, kind, key, 'unexpected key' FROM manifest_files WHERE key <> good_key
    UNION ALL SELECT run_date, game_key, kind, key, 'invalid sha256' FROM manifest_files WHERE length(sha256) <> 64
    UNION ALL SELECT run_date, game_key, kind, key, 'invalid uncompressed size' FROM manifest_files WHERE size <= 0
    UNION ALL SELECT run_date, game_key, kind, key, 'invalid fetched_at' FROM manifest_files WHERE fetched_at = 'yesterday'""",
    ["manifest_files"],
)
def manifest_structure_errors(spark: SparkSession, sf: str) -> DataFrame:
    return archive.structure_errors(views.manifest_files(spark, sf))


@query(
    "manifest_duplicates",
    "A12 D11",
    "run_date:s game_key:s kind:s n:i",
    """SELECT CAST(o_orderdate AS DATE) AS run_date, CASE WHEN o_custkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, o_orderstatus AS kind, count(*) AS n
    FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def manifest_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("run_date"),
        views.part_game(F.col("o_custkey")).alias("game_key"),
        F.col("o_orderstatus").alias("kind"),
    )
    return archive.duplicate_entries(rows)


@query(
    "snapshot_content_errors",
    "D11 F15 A30",
    "key:s error:s",
    """SELECT key, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'unreadable' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 'sha256 mismatch' END,
      CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN 'uncompressed size mismatch' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN 'invalid json' END,
      CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 1 THEN 'missing records' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 2 THEN 'price guide below 2 records' END], lambda x: x IS NOT NULL)) AS error
    FROM (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id FROM documents)""",
)
def snapshot_content_errors(spark: SparkSession, sf: str) -> DataFrame:
    # Whole documents as snapshot bodies: broken JSON, a foreign envelope, or one record.
    d = F.col("doc_id")
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    body = (
        F.when(d % 3 == 0, F.concat(F.lit("{"), F.col("text")))
        .when(d % 3 == 1, quoted)
        .otherwise(F.concat(F.lit('{"priceGuides": ['), quoted, F.lit("]}")))
    )
    docs = views.table(spark, sf, "documents").select(d.cast("string").alias("key"), d, body.alias("body"))
    files = docs.select(
        F.lit(date(2001, 1, 1)).alias("run_date"),
        F.lit("magic").alias("game_key"),
        F.lit("priceguide").alias("kind"),
        "key",
        F.when(d % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("body", 256)).alias("sha256"),
        (F.octet_length("body") + F.when(d % 5 == 0, 1).otherwise(0)).alias("size"),
    )
    return archive.content_errors(files, docs.filter(d % 11 != 0), min_records=2)


@query(
    "immutable_writes",
    "K4",
    "key:s status:s target_key:s",
    """SELECT key, status, CASE WHEN status = 'conflict' THEN 'snap/' || k || '.conflict-' || CASE WHEN k % 4 = 0 THEN 1 WHEN k % 8 = 1 THEN 3 WHEN k % 8 = 5 THEN 2 ELSE 1 END || '.json.gz' ELSE key END AS target_key
    FROM (SELECT o_orderkey AS k, 'snap/' || o_orderkey || '.json.gz' AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_custkey % 2 = 0 THEN 'existing' ELSE 'conflict' END AS status FROM orders)""",
)
def immutable_writes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = views.table(spark, sf, "orders")

    def key(suffix: str) -> Column:
        return F.concat(F.lit("snap/"), k.cast("string"), F.lit(suffix))

    candidates = orders.select(
        key(".json.gz").alias("key"),
        F.when(F.col("o_custkey") % 2 == 0, "same").otherwise("other").alias("sha256"),
    )
    stored = orders.filter(k % 3 != 0).select(key(".json.gz").alias("key"), F.lit("same").alias("sha256"))
    # Conflict copies 1 and 2, or 1 and 3, exist for some keys.
    first = orders.filter(k % 4 == 1).select(key(".conflict-1.json.gz").alias("key"), F.lit("x").alias("sha256"))
    second = orders.filter(k % 8 == 1).select(key(".conflict-2.json.gz").alias("key"), F.lit("x").alias("sha256"))
    third = orders.filter(k % 8 == 5).select(key(".conflict-3.json.gz").alias("key"), F.lit("x").alias("sha256"))
    index = stored.unionByName(first).unionByName(second).unionByName(third)
    return archive.plan_immutable_writes(candidates, index)


@query(
    "storage_categories",
    "A7 F4 S9",
    "category:s object_count:i bytes:i",
    """SELECT CASE n WHEN 0 THEN 'raw_snapshots' WHEN 1 THEN 'archive_manifests' WHEN 2 THEN 'normalized_data' WHEN 3 THEN 'normalized_data' WHEN 4 THEN 'shadow_indexes'
    WHEN 5 THEN 'pipeline_receipts' ELSE 'other' END AS category, count(*) AS object_count, sum(size) AS bytes FROM objects GROUP BY 1""",
    ["objects"],
)
def storage_categories(spark: SparkSession, sf: str) -> DataFrame:
    return archive.storage_by_category(_objects(spark, sf))


@query(
    "object_categories",
    "F4",
    "key:s category:s",
    """SELECT key, CASE n WHEN 0 THEN 'raw_snapshots' WHEN 1 THEN 'archive_manifests' WHEN 2 THEN 'normalized_data' WHEN 3 THEN 'normalized_data' WHEN 4 THEN 'shadow_indexes'
    WHEN 5 THEN 'pipeline_receipts' ELSE 'other' END AS category FROM objects""",
    ["objects"],
)
def object_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _objects(spark, sf).withColumn("category", ids.object_category(F.col("key")))


@query(
    "storage_totals",
    "A7 F14",
    "object_count:i total_bytes:i total_gb_decimal:f6 free_tier_usage_ratio:f8 status:s",
    """SELECT count(*) AS object_count, sum(size) AS total_bytes, sum(size) / 1e9 AS total_gb_decimal, round(sum(size) / 3e9, 8) AS free_tier_usage_ratio,
    CASE WHEN round(sum(size) / 3e9, 8) > 1 THEN 'over_free_tier' WHEN round(sum(size) / 3e9, 8) >= 0.8 THEN 'warning' ELSE 'within_free_tier' END AS status FROM objects""",
    ["objects"],
)
def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return archive.storage_totals(_objects(spark, sf), allowance=3_000_000_000)


@query(
    "largest_objects",
    "T4",
    "key:s size:i",
    "SELECT key, size FROM objects ORDER BY size DESC, key LIMIT 5",
    ["objects"],
)
def largest_objects(spark: SparkSession, sf: str) -> DataFrame:
    return archive.largest_objects(_objects(spark, sf))


@query(
    "archive_coverage",
    "A8",
    "expected_days:i manifest_count:i coverage_ratio:f8",
    """SELECT count(*) AS expected_days, count(*) FILTER (run_date IN (SELECT run_date FROM manifest_files)) AS manifest_count,
    count(*) FILTER (run_date IN (SELECT run_date FROM manifest_files)) / count(*)::DOUBLE AS coverage_ratio FROM days""",
    ["days", "manifest_files"],
)
def archive_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return archive.coverage(_days(spark), views.manifest_files(spark, sf))


@query(
    "sample_sizes",
    "T5",
    "run_date:s files:i sampled:i",
    """SELECT run_date, count(*) AS files, least(count(*), greatest(1, CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT))) AS sampled FROM manifest_files GROUP BY 1""",
    ["manifest_files"],
)
def sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    counts = views.manifest_files(spark, sf).groupBy("run_date").agg(F.count(F.lit(1)).alias("files"))
    return counts.withColumn("sampled", archive.sample_size(F.col("files"), 0.3))


@query(
    "sampled_files",
    "T5",
    "key:s",
    """SELECT key FROM (SELECT key, row_number() OVER (ORDER BY sha256('weekly' || key), key) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT key FROM manifest_files)) WHERE rn <= least(n, greatest(1, ceil(n * 0.05)))""",
    ["manifest_files"],
)
def sampled_files(spark: SparkSession, sf: str) -> DataFrame:
    return archive.sample_files(views.manifest_files(spark, sf), 0.05, "weekly")


@query(
    "inception_mismatches",
    "J12",
    "game_key:s problem:s",
    """SELECT n_name AS game_key, 'missing' AS problem FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'EXTRA_' || n_name, 'unexpected' FROM nation WHERE n_nationkey % 6 = 0""",
)
def inception_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    nation = views.table(spark, sf, "nation")
    games = nation.select(F.col("n_name").alias("game_key"))
    known = nation.filter(F.col("n_nationkey") % 5 != 0).select(F.col("n_name").alias("game_key"))
    extra = nation.filter(F.col("n_nationkey") % 6 == 0).select(F.concat(F.lit("EXTRA_"), F.col("n_name")).alias("game_key"))
    return archive.inception_mismatches(known.unionByName(extra), games)


@query(
    "projected_dates",
    "A29 F7",
    "first_full_observation_date:s first_eligible_effective_date:s first_monthly_rebalance_date:s",
    """SELECT m + 59 AS first_full_observation_date, m + 60 AS first_eligible_effective_date,
    CASE WHEN day(m + 60) = 1 THEN m + 60 ELSE CAST(date_trunc('month', m + 60) + INTERVAL 1 MONTH AS DATE) END AS first_monthly_rebalance_date
    FROM (SELECT max(first) AS m FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1))""",
)
def projected_dates(spark: SparkSession, sf: str) -> DataFrame:
    firsts = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("inception"))
    return archive.projected_dates(firsts, 60)


_AUDIT = """SELECT run_date, run_date || ': missing manifest' AS error FROM days WHERE run_date NOT IN (SELECT path_date FROM manifests)
    UNION ALL SELECT path_date, 'invalid manifest' FROM manifests WHERE malformed
    UNION ALL SELECT path_date, 'manifest run_date is ' || (path_date + 1) FROM manifests WHERE misdated
    UNION ALL SELECT run_date, 'missing ' || kind || ' for ' || game_key FROM (SELECT run_date, game_key, kind FROM expected_entries WHERE run_date IN (SELECT path_date FROM manifests WHERE NOT malformed)
      EXCEPT SELECT run_date, game_key, kind FROM manifest_files)
    UNION ALL SELECT run_date, 'unexpected manifest entry ' || game_key || '/' || kind FROM (SELECT run_date, game_key, kind FROM live_files
      EXCEPT SELECT run_date, game_key, kind FROM expected_entries)
    UNION ALL SELECT run_date, key || ': unsupported schema_version' FROM live_files WHERE schema_version <> 1
    UNION ALL SELECT run_date, key || ': unexpected key' FROM live_files WHERE key <> good_key
    UNION ALL SELECT run_date, key || ': invalid sha256' FROM live_files WHERE length(sha256) <> 64
    UNION ALL SELECT run_date, key || ': invalid uncompressed size' FROM live_files WHERE size <= 0
    UNION ALL SELECT run_date, key || ': invalid fetched_at' FROM live_files WHERE fetched_at = 'yesterday'"""
views.SQL["live_files"] = (
    ["manifest_files", "manifests"],
    "SELECT * FROM manifest_files WHERE run_date IN (SELECT path_date FROM manifests WHERE NOT malformed)",
)


def _audit_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = _manifests(spark, sf)
    live = found.filter(~F.col("malformed")).select(F.col("path_date").alias("run_date"))
    files = views.manifest_files(spark, sf).join(live, "run_date", "left_semi")
    return archive.audit_errors(_days(spark), found, files, _inceptions(spark))


@query(
    "audit_errors",
    "D10 J10 J11 J22 S2",
    "run_date:s error:s",
    _AUDIT,
    ["days", "manifests", "expected_entries", "manifest_files", "live_files"],
)
def audit_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _audit_errors(spark, sf)


@query(
    "public_archive_health",
    "P13 D16",
    "expected_days:i manifest_count:i coverage_ratio:f8 integrity_error_count:i gap_count:i total_bytes:i storage_status:s status:s",
    f"""SELECT (SELECT count(*) FROM days) AS expected_days, (SELECT count(*) FROM manifests WHERE NOT malformed) AS manifest_count,
    (SELECT count(*) FROM manifests WHERE NOT malformed) / (SELECT count(*) FROM days)::DOUBLE AS coverage_ratio, count(*) AS integrity_error_count,
    count(*) FILTER (error LIKE '%: missing manifest') AS gap_count, (SELECT sum(size) FROM objects) AS total_bytes, 'within_free_tier' AS storage_status, 'attention_required' AS status FROM ({_AUDIT})""",
    ["days", "manifests", "expected_entries", "manifest_files", "live_files", "objects"],
)
def public_archive_health(spark: SparkSession, sf: str) -> DataFrame:
    good = _manifests(spark, sf).filter(~F.col("malformed")).select(F.col("path_date").alias("run_date"))
    cover = archive.coverage(_days(spark), good)
    totals = archive.storage_totals(_objects(spark, sf), allowance=10**15)
    return archive.public_health(_audit_errors(spark, sf), cover, totals)


@query(
    "public_gaps",
    "P13 F6",
    "date:s reason:s",
    "SELECT run_date AS date, 'Daily archive manifest missing' AS reason FROM days WHERE run_date NOT IN (SELECT path_date FROM manifests)",
    ["days", "manifests"],
)
def public_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return archive.public_gaps(_audit_errors(spark, sf))


@query(
    "backfill_days",
    "A32 D9 J10",
    "run_date:s ok_runs:i errors:i status:s",
    """SELECT d.run_date, coalesce(r.n, 0) AS ok_runs, coalesce(e.n, 0) AS errors, CASE WHEN coalesce(e.n, 0) = 0 AND coalesce(r.n, 0) > 0 THEN 'pass' ELSE 'fail' END AS status
    FROM days d LEFT JOIN (SELECT run_date, count(*) AS n FROM manifest_files WHERE size > 0 GROUP BY 1) r USING (run_date)
    LEFT JOIN (SELECT run_date, count(*) AS n FROM manifest_files WHERE size = 0 GROUP BY 1) e USING (run_date)""",
    ["days", "manifest_files"],
)
def backfill_days(spark: SparkSession, sf: str) -> DataFrame:
    files = views.manifest_files(spark, sf)
    return archive.backfill_summary(_days(spark), files.filter("size > 0"), files.filter("size = 0"))


@query(
    "latest_pointers",
    "P14 S2",
    "date:s game:s kind:s key:s sha256_uncompressed:s",
    "SELECT run_date AS date, game_key AS game, kind, key, sha256 AS sha256_uncompressed FROM manifest_files",
    ["manifest_files"],
)
def latest_pointers(spark: SparkSession, sf: str) -> DataFrame:
    # A manifest lists one entry per game and kind, four in this archive.
    entry = F.struct(
        F.col("game_key").alias("game"),
        "kind",
        "key",
        F.col("sha256").alias("sha256_uncompressed"),
        F.col("size").alias("size_uncompressed"),
        "fetched_at",
    )
    docs = (
        views.manifest_files(spark, sf)
        .groupBy("run_date")
        .agg(F.collect_list(entry).alias("files"))
        .withColumn("malformed", F.lit(False))
    )
    pointer = manifest_source.latest_pointer(docs)
    return pointer.select("date", F.inline("files"))
