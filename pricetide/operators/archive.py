"""Archive manifests: validation, unchanged detection, immutable writes, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import inclusive_days, month_start_on_or_after
from pricetide.functions.ids import conflict_key, object_category, snapshot_key
from pricetide.functions.prices import budget_status, ratio
from pricetide.functions.text import missing_manifest_day
from pricetide.params import SOURCE_KINDS
from pricetide.sources.snapshots import record_list

# Storage allowance and minimum size of a price guide.
FREE_STORAGE_BYTES = 10_000_000_000
MIN_PRICEGUIDE_RECORDS = 1_000


def calendar_days(source: DataFrame, start: Column, end: Column, name: str = "run_date") -> DataFrame:
    """All days of [start, end]; the bounds are expressions over a one-row `source`."""
    return source.select(F.explode(inclusive_days(start, end)).alias(name))


def missing_days(days: DataFrame, manifests: DataFrame) -> DataFrame:
    """Calendar days without a manifest."""
    return days.join(manifests.select("run_date").distinct(), "run_date", "left_anti")


def expected_entries(days: DataFrame, inceptions: DataFrame) -> DataFrame:
    """(run_date, game_key, kind) a complete archive holds: a game counts from its inception.

    Both sides are calendar- and game-sized.
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in SOURCE_KINDS])).alias("kind")
    return (
        days.join(inceptions, F.col("run_date") >= F.col("inception"))
        .select("run_date", "game_key", kinds)
    )


def missing_entries(expected: DataFrame, files: DataFrame) -> DataFrame:
    return expected.join(files, ["run_date", "game_key", "kind"], "left_anti")


def unexpected_entries(expected: DataFrame, files: DataFrame) -> DataFrame:
    keys = ["run_date", "game_key", "kind"]
    return files.select(*keys).join(expected, keys, "left_anti")


def unchanged_from_previous(files: DataFrame) -> DataFrame:
    """Flag files whose content equals that of exactly the day before.

    A join on day + 1, not a lag: across a gap nothing counts as unchanged.
    """
    keys = ["run_date", "game_key", "kind"]
    before = files.select(
        F.date_add("run_date", 1).alias("run_date"), "game_key", "kind", F.col("sha256").alias("_before")
    )
    return (
        files.join(before, keys, "left")
        .withColumn("unchanged", F.coalesce(F.col("sha256") == F.col("_before"), F.lit(False)))
        .drop("_before")
    )


def structure_errors(files: DataFrame) -> DataFrame:
    """One row per structural error of a manifest file entry."""
    expected_key = snapshot_key(F.col("kind"), F.col("game_key"), F.col("run_date"))
    fetched = F.col("fetched_at")
    looks_iso = fetched.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    checks = F.array(
        F.when(F.col("schema_version") != 1, F.lit("unsupported schema_version")),
        F.when(F.col("key") != expected_key, F.lit("unexpected key")),
        F.when(F.length("sha256") != 64, F.lit("invalid sha256")),
        F.when(F.col("size") <= 0, F.lit("invalid uncompressed size")),
        F.when(
            ~F.coalesce(looks_iso & fetched.try_cast("timestamp").isNotNull(), F.lit(False)),
            F.lit("invalid fetched_at"),
        ),
    )
    return files.select(
        "run_date", "game_key", "kind", "key", F.explode(F.array_compact(checks)).alias("error")
    )


def duplicate_entries(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("run_date", "game_key", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def payload_records(body: Column, kind: Column) -> Column:
    """Record list accepted by manifest validation (a narrower envelope than ingest)."""

    def member(name: str) -> Column:
        value = F.get_json_object(body, f"$.{name}")
        return F.when(F.ltrim(value).startswith("["), value)

    chosen = F.when(F.ltrim(body).startswith("["), body).otherwise(
        F.when(kind == "priceguide", F.coalesce(member("priceGuides"), member("data"))).otherwise(
            member("products")
        )
    )
    return F.from_json(chosen, "array<string>")


def measure_bodies(documents: DataFrame) -> DataFrame:
    """Measures of landed bodies (key, body): size, hash, whether JSON, and both record counts.

    Bodies are measured beside their scan; what is shuffled later is these small columns.
    """
    body = F.col("body")
    guide, other = (payload_records(body, F.lit(kind)) for kind in ("priceguide", "catalogue"))
    return documents.filter(body.isNotNull()).select(
        "key",
        F.sha2(body, 256).alias("sha256"),
        F.octet_length(body).cast("bigint").alias("size"),
        F.try_parse_json(body).isNotNull().alias("valid"),
        F.when(guide.isNotNull(), F.size(guide)).cast("bigint").alias("guide_records"),
        F.when(other.isNotNull(), F.size(other)).cast("bigint").alias("other_records"),
    )


def measured_files(measures: DataFrame) -> DataFrame:
    """The same columns from the measures of snapshot files; files that can't be read have none."""
    return measures.filter(F.col("sha256").isNotNull()).select(
        "key",
        "sha256",
        "size",
        "valid",
        F.coalesce("bare", "priceGuides", "data").alias("guide_records"),
        F.coalesce("bare", "products").alias("other_records"),
    )


def compare_content(
    files: DataFrame, measured: DataFrame, min_records: int = MIN_PRICEGUIDE_RECORDS
) -> DataFrame:
    """Errors of declared files against the measures of what landed: hash, size, JSON, record count."""
    landed = measured.select(
        "key",
        F.col("sha256").alias("_sha"),
        F.col("size").alias("_size"),
        F.col("valid").alias("_valid"),
        F.col("guide_records").alias("_guide"),
        F.col("other_records").alias("_other"),
    )
    joined = files.select("run_date", "game_key", "kind", "key", "sha256", "size").join(landed, "key", "left")
    is_guide = F.col("kind") == "priceguide"
    found = F.when(is_guide, F.col("_guide")).otherwise(F.col("_other"))
    valid = F.col("_valid")
    checks = F.array(
        F.when(F.col("_sha").isNull(), F.lit("unreadable")),
        F.when(F.col("_sha") != F.col("sha256"), F.lit("sha256 mismatch")),
        F.when(F.col("_size") != F.col("size"), F.lit("uncompressed size mismatch")),
        F.when(~valid, F.lit("invalid json")),
        F.when(valid & found.isNull(), F.lit("missing records")),
        F.when(valid & is_guide & (found < min_records), F.lit(f"price guide below {min_records} records")),
    )
    return joined.select(
        "run_date", "game_key", "kind", "key", F.explode(F.array_compact(checks)).alias("error")
    )


def content_errors(
    files: DataFrame, documents: DataFrame, min_records: int = MIN_PRICEGUIDE_RECORDS
) -> DataFrame:
    """Compare declared files with landed bodies (key, body)."""
    return compare_content(files, measure_bodies(documents), min_records)


def source_metadata(documents: DataFrame, min_records: int = MIN_PRICEGUIDE_RECORDS) -> DataFrame:
    """Record count and creation time per landed document, with the size rule's verdict."""
    records = record_list(F.col("body"))
    count = F.coalesce(F.size(records), F.lit(-1))
    return documents.select(
        *[c for c in documents.columns if c != "body"],
        F.get_json_object("body", "$.createdAt").alias("source_created_at"),
        F.when(records.isNotNull(), F.size(records)).alias("record_count"),
        F.when(records.isNull(), "missing records")
        .when((F.col("kind") == "priceguide") & (count < min_records), "below minimum")
        .otherwise("ok")
        .alias("verdict"),
    )


def plan_immutable_writes(candidates: DataFrame, archive: DataFrame) -> DataFrame:
    """Decide each candidate's fate against the archive index (key, sha256).

    created: the key is free. existing: same content. conflict: other content; the
    candidate keeps the next free conflict number of its key.
    """
    number = F.regexp_extract("key", r"\.conflict-(\d+)\.json\.gz$", 1)
    base = F.regexp_replace("key", r"\.conflict-\d+\.json\.gz$", ".json.gz")
    taken = archive.filter(number != "").select(base.alias("key"), number.cast("int").alias("n"))
    # Next free number: the smallest successor of 0 or a taken number that is not taken.
    after = taken.select("key", (F.col("n") + 1).alias("n")).unionByName(
        taken.select("key", F.lit(1).alias("n"))
    )
    free = (
        after.join(taken, ["key", "n"], "left_anti").groupBy("key").agg(F.min("n").alias("next_free"))
    )
    stored = archive.select("key", F.col("sha256").alias("stored_sha"))
    joined = candidates.join(stored, "key", "left").join(free, "key", "left")
    status = (
        F.when(F.col("stored_sha").isNull(), "created")
        .when(F.col("stored_sha") == F.col("sha256"), "existing")
        .otherwise("conflict")
    )
    n = F.coalesce("next_free", F.lit(1))
    return (
        joined.withColumn("status", status)
        .withColumn(
            "target_key",
            F.when(F.col("status") == "conflict", conflict_key(F.col("key"), n)).otherwise(F.col("key")),
        )
        .drop("stored_sha", "next_free")
    )


def storage_by_category(objects: DataFrame) -> DataFrame:
    """Object count and bytes per key category."""
    return objects.groupBy(object_category(F.col("key")).alias("category")).agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("size").cast("bigint").alias("bytes")
    )


def storage_totals(objects: DataFrame, allowance: int = FREE_STORAGE_BYTES) -> DataFrame:
    """Totals and budget status of all stored objects."""
    totals = objects.agg(
        F.count(F.lit(1)).alias("object_count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
    return (
        totals.withColumn("total_gb_decimal", F.round(F.col("total_bytes") / 1e9, 6))
        .withColumn("free_tier_usage_ratio", ratio(F.col("total_bytes"), F.lit(allowance)))
        .withColumn("status", budget_status(F.col("free_tier_usage_ratio")))
    )


def largest_objects(objects: DataFrame, n: int = 5) -> DataFrame:
    """The `n` largest objects (a top-k: each task keeps at most n rows)."""
    return objects.select("key", "size").orderBy(F.desc("size"), F.asc("key")).limit(n)


def sample_size(total: Column, rate: float) -> Column:
    wanted = F.greatest(F.lit(1), F.ceil(total * F.lit(rate)))
    return F.when(total > 0, F.least(total, wanted)).otherwise(F.lit(0)).cast("bigint")


def sample_order(seed: str) -> Column:
    """The order in which a seeded sample takes keys."""
    return F.sha2(F.concat(F.lit(seed), F.col("key")), 256)


def sampled_bodies(documents: DataFrame, sampled: DataFrame, seed: str) -> DataFrame:
    """The documents of sampled keys; others are left out beside the scan, before their body is used.

    A sample holds the first keys in its order, so the last of them is a scalar that each
    document's key is compared with. The semi join after it drops keys that no file names.
    """
    order = sample_order(seed)
    last = sampled.agg(F.max(order)).scalar()
    return documents.filter(order <= last).join(sampled.select("key"), "key", "left_semi")


def sample_files(files: DataFrame, rate: float, seed: str) -> DataFrame:
    """A seeded sample of exactly min(n, max(1, ceil(n * rate))) distinct keys.

    The order is the SHA-256 of seed and key, so a rerun verifies the same files.
    Keys fall evenly over the first 16 bits of it: a count of those cells (65,536 rows at
    most) finds the cell that the sample ends in, and only that cell's keys are ranked.
    """
    keys = files.select("key").distinct().withColumn("_order", sample_order(seed)).withColumn("_cell", F.substring("_order", 1, 4))
    cells = keys.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    size = cells.agg(sample_size(F.coalesce(F.sum("_n"), F.lit(0)), rate).alias("n")).select("n").scalar()
    wanted = cells.filter(F.col("_before") < size).withColumn("_left", size - F.col("_before"))
    whole = keys.join(wanted.filter(F.col("_n") <= F.col("_left")), "_cell", "left_semi")
    last = keys.join(wanted.filter(F.col("_n") > F.col("_left")), "_cell")
    inside = Window.partitionBy("_cell").orderBy("_order", "key")
    cut = last.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= F.col("_left"))
    return whole.select("key").unionByName(cut.select("key"))


def coverage(days: DataFrame, manifests: DataFrame) -> DataFrame:
    """Expected days, days with a manifest and their ratio."""
    present = manifests.select("run_date").distinct().withColumn("present", F.lit(1))
    return (
        days.join(present, "run_date", "left")
        .agg(
            F.count(F.lit(1)).alias("expected_days"),
            F.count("present").alias("manifest_count"),
        )
        .withColumn("coverage_ratio", ratio(F.col("manifest_count"), F.col("expected_days")))
    )


def inception_mismatches(inceptions: DataFrame, games: DataFrame) -> DataFrame:
    """Games without an inception date and inceptions of unknown games."""
    return (
        games.select("game_key", F.lit(1).alias("g"))
        .join(inceptions.select("game_key", F.lit(1).alias("i")), "game_key", "full_outer")
        .filter(F.col("g").isNull() | F.col("i").isNull())
        .select("game_key", F.when(F.col("i").isNull(), "missing").otherwise("unexpected").alias("problem"))
    )


def projected_dates(inceptions: DataFrame, lookback_days: int) -> DataFrame:
    """Dates reached if the archive stays gapless from the latest inception on."""
    latest = inceptions.agg(F.max("inception").alias("latest"))
    eligible = F.date_add("latest", lookback_days)
    return latest.select(
        F.date_add("latest", lookback_days - 1).alias("first_full_observation_date"),
        eligible.alias("first_eligible_effective_date"),
        month_start_on_or_after(eligible).alias("first_monthly_rebalance_date"),
    )


def audit_errors(
    days: DataFrame,
    manifests: DataFrame,
    files: DataFrame,
    inceptions: DataFrame,
    content: DataFrame | None = None,
) -> DataFrame:
    """All archive errors as (run_date, error).

    `manifests` has path_date, run_date (text) and malformed; `files` has run_date
    as a date; `content` are the content errors of the sampled files.
    """
    seen = manifests.select(F.col("path_date").alias("run_date")).distinct()
    gap = days.join(seen, "run_date", "left_anti").select(
        "run_date", F.concat(F.col("run_date").cast("string"), F.lit(": missing manifest")).alias("error")
    )
    broken = manifests.filter("malformed").select(
        F.col("path_date").alias("run_date"), F.lit("invalid manifest").alias("error")
    )
    misdated = manifests.filter(
        ~F.col("malformed") & (F.col("run_date") != F.col("path_date").cast("string"))
    ).select(
        F.col("path_date").alias("run_date"),
        F.concat(F.lit("manifest run_date is "), F.col("run_date")).alias("error"),
    )
    present = days.join(seen, "run_date", "left_semi").join(
        manifests.filter("malformed").select(F.col("path_date").alias("run_date")), "run_date", "left_anti"
    )
    expected = expected_entries(present, inceptions)
    absent = missing_entries(expected, files).select(
        "run_date", F.concat_ws(" ", F.lit("missing"), "kind", F.lit("for"), "game_key").alias("error")
    )
    extra = unexpected_entries(expected, files).select(
        "run_date",
        F.concat(F.lit("unexpected manifest entry "), F.concat_ws("/", "game_key", "kind")).alias("error"),
    )
    double = duplicate_entries(files).select("run_date", F.lit("duplicate game/kind entries").alias("error"))
    entry = structure_errors(files).select(
        "run_date", F.concat_ws(": ", "key", "error").alias("error")
    )
    parts = [gap, broken, misdated, absent, extra, double.distinct(), entry]
    if content is not None:
        parts.append(content.select("run_date", F.concat_ws(": ", "key", "error").alias("error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def public_health(errors: DataFrame, cover: DataFrame, totals: DataFrame) -> DataFrame:
    """Publishable archive health: aggregates and gap days only, no keys."""
    counts = errors.agg(
        F.struct(
            F.count(F.lit(1)).alias("integrity_error_count"),
            F.count(missing_manifest_day(F.col("error"))).alias("gap_count"),
        )
    ).scalar()
    storage = totals.select(
        F.struct("total_bytes", "free_tier_usage_ratio", F.col("status").alias("storage_status"))
    ).scalar()
    return (
        cover.withColumn("counts", counts)
        .withColumn("storage", storage)
        .select(*cover.columns, "counts.*", "storage.*")
        .withColumn(
            "status", F.when(F.col("integrity_error_count") == 0, "healthy").otherwise("attention_required")
        )
    )


def public_gaps(errors: DataFrame) -> DataFrame:
    return errors.select(missing_manifest_day(F.col("error")).alias("date")).filter(
        F.col("date").isNotNull()
    ).withColumn("reason", F.lit("Daily archive manifest missing"))


def backfill_summary(days: DataFrame, runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Status per day of a backfill range: runs that succeeded, errors, and pass/fail."""
    ok = runs.groupBy("run_date").agg(F.count(F.lit(1)).alias("ok_runs"))
    bad = errors.groupBy("run_date").agg(F.count(F.lit(1)).alias("errors"))
    return (
        days.join(ok, "run_date", "left")
        .join(bad, "run_date", "left")
        .fillna({"ok_runs": 0, "errors": 0})
        .withColumn(
            "status", F.when((F.col("errors") == 0) & (F.col("ok_runs") > 0), "pass").otherwise("fail")
        )
    )

