"""The jobs and readers over files that Spark writes from the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.params import Methodology, definitions_frame, literal_table
from pricetide.plans import daily
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.schemas import HISTORY, QUALITY, struct
from pricetide.session import cut_lineage, store
from pricetide.sinks import exports, tables
from pricetide.sources import categories, holdings, manifests, snapshot_files, snapshots
from pricetide.sources.object_files import list_objects, write_objects

_SEED = "weekly"
_RATE = 0.3
_FEWEST = 20
#: The hash that a manifest declares where it is planted wrong: every fifth month's price guide.
_WRONG = "f" * 64


def _declared_sha() -> Column:
    planted = (F.col("kind") == "priceguide") & (F.month("run_date") % 5 == 0)
    return F.when(planted, F.lit(_WRONG)).otherwise(F.col("sha256"))


def _archive(spark: SparkSession, sf: str) -> str:
    return views.write_archive(spark, views.monthly_listings(spark, sf), _declared_sha())


@query(
    "snapshot_file_records",
    "S1 P11 F18",
    "game_key:s run_date:s kind:s source_pos:i cm_product_id:i cm_category_id:i base_avg:f4 name:s",
    """SELECT game_key, run_date, 'priceguide' AS kind, source_pos, pid AS cm_product_id, 1 AS cm_category_id, price AS base_avg, NULL AS name FROM listings
    UNION ALL SELECT game_key, run_date, 'catalogue', source_pos, pid, NULL, NULL, p_name FROM listings JOIN part ON p_partkey = pid""",
    ["listings"],
)
def snapshot_file_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of snapshot files through the data source; no document is a value."""
    return snapshots.typed_records(snapshot_files.read_records(spark, views.write_archive(spark, views.monthly_listings(spark, sf))))


@query(
    "snapshot_file_measures",
    "S1 A30",
    "key:s valid:b created_at:s records:i same_as_declared:b",
    """SELECT key, true AS valid, run_date AS created_at, records, NOT (kind = 'priceguide' AND month(run_date) % 5 = 0) AS same_as_declared FROM listing_files""",
    ["listing_files"],
)
def snapshot_file_measures(spark: SparkSession, sf: str) -> DataFrame:
    root = _archive(spark, sf)
    declared = manifests.manifest_files(manifests.read_manifests(spark, f"{root}/manifests"))
    declared = declared.select("key", F.col("sha256").alias("stated"), F.col("size").alias("stated_size"))
    measured = snapshot_files.read_measures(spark, f"{root}/cardmarket").join(declared, "key")
    same = (F.col("sha256") == F.col("stated")) & (F.col("size") == F.col("stated_size"))
    return measured.select("key", "valid", "created_at", F.coalesce("products", "priceGuides").alias("records"), same.alias("same_as_declared"))


@query(
    "manifest_file_entries",
    "S2 D11",
    "path_date:s run_date:s game_key:s kind:s key:s fetched_at:s unchanged:b",
    """SELECT run_date AS path_date, run_date, game_key, kind, key, run_date || 'T05:00:00+00:00' AS fetched_at, false AS unchanged FROM listing_files""",
    ["listing_files"],
)
def manifest_file_entries(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.manifest_files(manifests.read_manifests(spark, f"{_archive(spark, sf)}/manifests"))


@query(
    "object_listing",
    "S9 A7",
    "key:s tagged:b empty:b",
    """SELECT key, true AS tagged, false AS empty FROM listing_files UNION ALL SELECT DISTINCT 'manifests/' || run_date || '.json', true, false FROM listing_files""",
    ["listing_files"],
)
def object_listing(spark: SparkSession, sf: str) -> DataFrame:
    listed = list_objects(spark, _archive(spark, sf), depth=3)
    return listed.select("key", F.col("etag").isNotNull().alias("tagged"), (F.col("size") == 0).alias("empty"))


views.SQL["audit_sample"] = (
    ["listing_files"],
    f"""SELECT * FROM listing_files ORDER BY sha256('{_SEED}' || key) LIMIT (SELECT greatest(1, CAST(ceil(count(*) * {_RATE}::DOUBLE) AS BIGINT)) FROM listing_files)""",
)
views.SQL["archive_errors"] = (
    ["listing_files", "audit_sample"],
    f"""SELECT day AS run_date, day || ': missing manifest' AS error FROM (SELECT CAST(unnest(generate_series(min(run_date), max(run_date), INTERVAL 1 DAY)) AS DATE) AS day FROM listing_files)
    WHERE day NOT IN (SELECT run_date FROM listing_files)
    UNION ALL SELECT run_date, 'unexpected manifest entry ' || game_key || '/' || kind FROM listing_files WHERE game_key = 'pokemon' AND run_date < DATE '1993-06-01'
    UNION ALL SELECT run_date, 'missing ' || k || ' for ' || g FROM (SELECT DISTINCT run_date FROM listing_files), (VALUES ('priceguide'), ('catalogue')) a(k), (VALUES ('onepiece'), ('pokemon')) b(g)
      WHERE (g = 'onepiece' OR run_date >= DATE '1993-06-01') AND (run_date, g, k) NOT IN (SELECT (run_date, game_key, kind) FROM listing_files)
    UNION ALL SELECT run_date, key || ': sha256 mismatch' FROM audit_sample WHERE kind = 'priceguide' AND month(run_date) % 5 = 0
    UNION ALL SELECT run_date, key || ': price guide below {_FEWEST} records' FROM audit_sample WHERE kind = 'priceguide' AND records < {_FEWEST}""",
)


def _audit(spark: SparkSession, sf: str):
    from pricetide.plans.audit import audit_archive

    root = _archive(spark, sf)
    found = manifests.read_manifests(spark, f"{root}/manifests")
    # The calendar of the audit is that of the line items.
    first, last = found.agg(F.min("path_date"), F.max("path_date")).first()
    inceptions = [("onepiece", date(1990, 1, 1)), ("pokemon", date(1993, 6, 1))]
    return audit_archive(
        spark,
        found,
        manifests.manifest_files(found),
        root,
        list_objects(spark, root),
        views.definitions(spark),
        spark.createDataFrame([], QUALITY),
        literal_table(spark, inceptions, struct("game_key string, inception date")),
        first,
        last,
        _RATE,
        _SEED,
        min_records=_FEWEST,
    )


@query("archive_audit_errors", "D10 D11 J10 J11", "run_date:s error:s", "SELECT * FROM archive_errors", ["archive_errors"])
def archive_audit_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).errors


@query(
    "archive_audit",
    "D10 T5 A8",
    "status:s error_count:i file_count:i verified_file_count:i bodies_read:i same_as_sample:b snapshot_object_count:i expected_days:i manifest_count:i cutover_state:s",
    """SELECT 'fail' AS status, (SELECT count(*) FROM archive_errors) AS error_count, (SELECT count(*) FROM listing_files) AS file_count, (SELECT count(*) FROM audit_sample) AS verified_file_count,
    (SELECT count(*) FROM audit_sample) AS bodies_read, true AS same_as_sample, (SELECT count(*) FROM listing_files) AS snapshot_object_count,
    (SELECT max(run_date) - min(run_date) + 1 FROM listing_files) AS expected_days, (SELECT count(DISTINCT run_date) FROM listing_files) AS manifest_count, 'accumulating' AS cutover_state""",
    ["listing_files", "audit_sample", "archive_errors"],
)
def archive_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's totals, with the bodies that were opened: those of the sample and no others."""
    report = _audit(spark, sf)
    # One row each.
    read = report.measured.agg(F.count(F.lit(1)).alias("bodies_read"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("a"))
    taken = report.sampled.agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("b"))
    row = report.summary
    for side in (report.coverage, read, taken):
        row = row.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return row.withColumn("same_as_sample", F.col("a") == F.col("b"))


_BACKFILLED = """WITH days AS (SELECT CAST(unnest(generate_series(min(run_date), max(run_date), INTERVAL 1 DAY)) AS DATE) AS run_date FROM listing_files),
    notes AS (SELECT game_key, run_date, count(DISTINCT kind) = 2 AND month(run_date) % 5 <> 0 AS good FROM listing_files GROUP BY 1, 2)
    SELECT d.run_date, count(*) FILTER (good) AS ok_runs, count(*) FILTER (NOT good) AS errors, CASE WHEN count(*) FILTER (good) > 0 AND count(*) FILTER (NOT good) = 0 THEN 'pass' ELSE 'fail' END AS status,
    coalesce(any_value(rows), 0) AS price_rows FROM days d LEFT JOIN notes n USING (run_date)
    LEFT JOIN (SELECT run_date, count(*) AS rows FROM listings WHERE month(run_date) % 5 <> 0 GROUP BY 1) p USING (run_date) GROUP BY d.run_date"""


@query("resumed_backfill", "D9 D6 S2 K10", "run_date:s ok_runs:i errors:i status:s price_rows:i", _BACKFILLED, ["listings", "listing_files"])
def resumed_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill stream over two arrivals of manifests, the second run going on from the first's
    checkpoint; days with a wrong manifest are rejected."""
    sales = store(views.monthly_sales(spark, sf))
    root, out, checkpoint = views.scratch(spark), views.scratch(spark), views.scratch(spark)
    known = views.categories(spark)
    first, last = sales.agg(F.min("run_date"), F.max("run_date")).first()
    middle = F.lit(first + (last - first) / 2)
    for arrived in (F.col("run_date") < middle, F.col("run_date") >= middle):
        views.write_archive(spark, views.listing_records(sales.filter(arrived)), _declared_sha(), root)
        daily.start_backfill(spark, root, known, out, checkpoint, first, last, 60, 1).awaitTermination()
    status = daily.backfill_status(spark, out, first, last)
    rows = tables.read_stored(spark, f"{out}/prices").groupBy(F.col("value_date").alias("run_date")).agg(F.count(F.lit(1)).alias("price_rows"))
    return status.join(rows, "run_date", "left").fillna(0, ["price_rows"])


views.SQL["last_day"] = (
    ["archive_calendar", "price_panel"],
    "SELECT greatest((SELECT max(value_date) FROM archive_calendar), (SELECT max(value_date) FROM price_panel)) AS d",
)


@query(
    "recalculated_indexes",
    "D8 K2 K3 K10",
    "output:s index_code:s rows:i total:f2 changed:b output_rows:i",
    """SELECT output, index_code, rows, total, true AS changed, sum(rows) OVER (PARTITION BY output) AS output_rows FROM (
      SELECT 'daily_values' AS output, index_code, count(*) AS rows, sum(index_value) AS total FROM fold_daily_values GROUP BY 2
      UNION ALL SELECT 'contributions', index_code, count(*), sum(contribution * 1000) FROM fold_contributions GROUP BY 2
      UNION ALL SELECT 'members', index_code, count(*), sum(rank) FROM fold_members WHERE effective_date <= (SELECT d FROM last_day) GROUP BY 2
      UNION ALL SELECT 'rebalances', index_code, count(*), sum(n) FROM (SELECT index_code, effective_date, count(*) AS n FROM ranked JOIN qualified USING (index_code, effective_date) WHERE effective_date <= (SELECT d FROM last_day) GROUP BY 1, 2) GROUP BY 2)""",
    ["last_day", "fold_daily_values", "fold_contributions", "fold_members", "ranked", "qualified"],
)
def recalculated_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """The recalculation job: its stored outputs and the receipts it gives for them."""
    from pricetide.plans.indexes import run_calc

    panel = cut_lineage(views.price_panel(spark, sf))
    calendar = cut_lineage(views.archive_calendar(spark, sf))
    # The run is that of the last observed day.
    run_date = max(calendar.agg(F.max("value_date")).first()[0], panel.agg(F.max("value_date")).first()[0])
    root = views.scratch(spark)
    receipts = run_calc(spark, panel, views.products(spark, sf), calendar, views.METHOD, run_date, root)
    changed = receipts.select(F.regexp_extract("output", r"([^/]+)$", 1).alias("output"), "changed", F.col("rows").alias("output_rows"))
    amounts = {"daily_values": F.col("index_value"), "contributions": F.col("contribution") * 1000, "members": F.col("rank"), "rebalances": F.col("eligible_count")}
    out = None
    for output, amount in amounts.items():
        stored = tables.read_stored(spark, f"{root}/{output}").groupBy("index_code").agg(F.count(F.lit(1)).alias("rows"), F.sum(amount).cast("double").alias("total"))
        stored = stored.withColumn("output", F.lit(output))
        out = stored if out is None else out.unionByName(stored)
    return out.join(changed, "output")


@query(
    "public_export",
    "K8 K5 S8",
    "output:s index_code:s rows:i total:f2",
    """WITH shown AS (SELECT index_code FROM history_definitions WHERE status = 'published' AND history_start_kind = 'published')
    SELECT 'summary' AS output, index_code, 1 AS rows, target_size AS total FROM history_definitions
    UNION ALL SELECT 'history', index_code, count(*), sum(index_value) FROM history WHERE index_code IN (FROM shown) GROUP BY 2
    UNION ALL SELECT 'constituents', index_code, count(*), sum(n_constituents_active) FROM history WHERE index_code IN (FROM shown) GROUP BY 2
    UNION ALL SELECT 'rebalances', index_code, count(*), sum(month(value_date)) FROM history WHERE day(value_date) = 1 AND index_code IN (FROM shown) GROUP BY 2
    UNION ALL SELECT 'search', p_brand, count(*), sum(p_size) FROM part GROUP BY 2""",
    ["history", "history_definitions"],
)
def public_export(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of the public site, written and read back; indexes that aren't published have a summary only."""
    definitions, history = views.history_definitions(spark, sf), cut_lineage(views.history(spark, sf))
    first = history.filter(F.dayofmonth("value_date") == 1)
    inputs = {
        "summary": definitions.withColumn("total", F.col("target_size")),
        "history": history.withColumn("total", F.col("index_value")),
        "constituents": history.withColumn("total", F.col("n_constituents_active")),
        "rebalances": first.withColumn("total", F.month("value_date")),
        "search": views.table(spark, sf, "part").select(F.col("p_brand").alias("index_code"), "p_name", F.col("p_size").alias("total")),
    }
    root = views.scratch(spark)
    exports.write_public_export(definitions, *inputs.values(), root)
    out = None
    for name in inputs:
        stored = spark.read.json(f"{root}/{name}").groupBy("index_code").agg(F.count(F.lit(1)).alias("rows"), F.sum("total").cast("double").alias("total"))
        stored = stored.withColumn("output", F.lit(name))
        out = stored if out is None else out.unionByName(stored)
    return out


@query(
    "static_json_tables",
    "S8",
    "index_code:s value_date:s index_value:f2 n_constituents_active:i calc_version:s",
    "SELECT replace(index_code, ' ', '-') AS index_code, value_date, index_value, n_constituents_active, calc_version FROM history",
    ["history"],
)
def static_json_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON list per index, one file each, read as one table."""
    from pricetide.sources.tables import read_static_json

    rows = views.history(spark, sf)
    key = F.concat(F.replace("index_code", F.lit(" "), F.lit("-")), F.lit("/history.json"))
    record = F.to_json(F.struct(*[c for c in rows.columns if c != "index_code"]))
    first = F.min("value_date").over(views.by("index_code")) == F.col("value_date")
    lines = rows.select(key.alias("key"), F.unix_date("value_date").alias("pos"), F.concat(F.when(first, "[").otherwise(","), record).alias("text"))
    ends = rows.select(key.alias("key"), F.lit(2**31 - 1).alias("pos"), F.lit("]").alias("text")).distinct()
    root = views.scratch(spark)
    write_objects(lines.unionByName(ends), root).count()
    return read_static_json(spark, f"{root}/*/history.json", HISTORY)


@query(
    "holdings_files",
    "S7 F19",
    "portfolio:s line:i error:s cm_product_id:i variant_key:s quantity:f4 cost_basis_eur:f2",
    """WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) + 1 AS line FROM lineitem)
    SELECT 'p' || l_suppkey AS portfolio, line, CASE WHEN l_partkey = 0 THEN 'Invalid cm_product_id' WHEN l_tax = 0 THEN 'Invalid quantity' END AS error, nullif(l_partkey, 0) AS cm_product_id,
    CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS variant_key, CASE WHEN l_tax <> 0 THEN l_quantity END AS quantity, CASE WHEN l_discount > 0.02 THEN l_extendedprice END AS cost_basis_eur
    FROM lines""",
)
def holdings_files(spark: SparkSession, sf: str) -> DataFrame:
    """A holdings file for each supplier, read from disk."""
    from pyspark.sql import Window

    line = views.spread(views.table(spark, sf, "lineitem"), "l_suppkey")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    key = F.concat(F.lit("p"), F.col("l_suppkey").cast("string"), F.lit(".csv"))
    cells = F.concat_ws(
        " , ",
        F.col("l_partkey").cast("string"),
        F.when(F.col("l_returnflag") == "R", "foil").otherwise(""),
        F.when(F.col("l_tax") == 0, "none").otherwise(F.col("l_quantity").cast("string")),
        F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice").cast("string")).otherwise(""),
    )
    rows = line.select(key.alias("key"), F.row_number().over(order).alias("pos"), cells.alias("text"))
    header = F.lit("﻿cm_product_id,variant_key, quantity ,cost_basis_eur")
    # The suppliers come from the table itself, so that few rows of each task are shuffled for them.
    suppliers = views.table(spark, sf, "lineitem").select("l_suppkey").distinct()
    head = suppliers.select(key.alias("key"), F.lit(0).alias("pos"), header.alias("text"))
    root = views.scratch(spark)
    write_objects(rows.unionByName(head), root).count()
    documents = holdings.read_holdings(spark, root, "*.csv")
    named = F.regexp_extract("portfolio_id", r"/(p\d+)\.csv$", 1).alias("portfolio")
    return holdings.parse_holdings(documents).select(named, "*")


@query(
    "category_map_file",
    "S6 F2",
    "label:s kind:s parts:i",
    """SELECT lower(p_type) AS label, CASE min(p_size) % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'sealed' ELSE 'other' END AS kind, count(*) AS parts FROM part GROUP BY 1""",
)
def category_map_file(spark: SparkSession, sf: str) -> DataFrame:
    """A category map written from the parts' types, loaded, and used to classify the parts."""
    import json
    from pathlib import Path
    from tempfile import TemporaryDirectory

    from pricetide.operators.normalize import classify

    part = views.table(spark, sf, "part")
    kind = F.element_at(F.array(F.lit("single"), F.lit("sealed"), F.lit("other")), (F.min("p_size") % 3 + 1).cast("int"))
    # A configuration file has as many labels as there are types.
    labels = part.groupBy(F.lower("p_type").alias("label")).agg(kind.alias("kind")).collect()
    mapping = {k: sorted(f" {r['label'].upper()}\t" for r in labels if r["kind"] == k) for k in ("single", "sealed", "other")}
    with TemporaryDirectory() as folder:
        path = Path(folder) / "categories.json"
        path.write_text(json.dumps(mapping))
        known = categories.load_category_map(spark, path)
    rows = classify(part.select(F.col("p_type").alias("raw_category")), known)
    return rows.groupBy(F.lower("raw_category").alias("label"), F.col("product_kind").alias("kind")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "methodology_file",
    "S5 P12",
    "index_code:s name:s game_key:s universe:s target_size:i base_date:s base_value:f2 status:s min_price:f2",
    """SELECT 'B' || row_number() OVER (ORDER BY p_brand) AS index_code, p_brand AS name, CASE WHEN count(*) % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key,
    CASE WHEN max(p_size) % 2 = 0 THEN 'singles' ELSE 'sealed' END AS universe, count(*) AS target_size, DATE '1995-01-01' + min(p_size) AS base_date, 1000.0 AS base_value, 'draft' AS status,
    CASE WHEN max(p_size) % 2 = 0 THEN 2.5 ELSE 10 END AS min_price FROM part GROUP BY p_brand""",
)
def methodology_file(spark: SparkSession, sf: str) -> DataFrame:
    """A methodology written from the brands and loaded: one index definition each."""
    import json
    from datetime import timedelta
    from pathlib import Path
    from tempfile import TemporaryDirectory

    part = views.table(spark, sf, "part")
    # Definitions are configuration: one for each brand.
    brands = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("most"), F.min("p_size").alias("least")).orderBy("p_brand").collect()
    raw = {
        "methodology_version": "1.3.0", "price_field_primary": "price_avg", "price_field_fallback": "price_low", "min_price_eur": {"singles": 2.5, "sealed": "10"},
        "min_observation_ratio": 0.5, "price_floor_observation_ratio": 0.5, "max_suspect_zero_ratio": 0.1, "daily_return_cap": 0.25, "buffer_retention_multiplier": 1.2,
        "buffer_entry_multiplier": 0.9, "seasoning_days": 1, "min_history_days": 1, "carry_forward_max_days": 1, "selection_lookback_days": 30,
        "indexes": [
            {"code": f"B{i}", "name": b["p_brand"], "game_key": "onepiece" if b["n"] % 2 == 0 else "pokemon", "universe": "singles" if b["most"] % 2 == 0 else "sealed",
             "target_size": str(b["n"]), "base_date": str(date(1995, 1, 1) + timedelta(days=b["least"])), "status": "draft"}
            for i, b in enumerate(brands, 1)
        ],
    }
    with TemporaryDirectory() as folder:
        path = Path(folder) / "methodology.json"
        path.write_text(json.dumps(raw))
        method = Methodology.load(path)
    return definitions_frame(spark, method)
