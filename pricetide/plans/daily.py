"""Daily normalisation and backfill: landed snapshots to catalogue and price tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricetide.operators import merge, normalize
from pricetide.operators.archive import (
    MIN_PRICEGUIDE_RECORDS,
    compare_content,
    duplicate_entries,
    measure_bodies,
    measured_files,
    snapshot_key,
    structure_errors,
)
from pricetide.params import SOURCE_KINDS
from pricetide.schemas import PRICE_TABLE, PRICES, PRODUCTS, SETS, VARIANTS, struct
from pricetide.session import cut_lineage, fits_broadcast, store
from pricetide.sinks.tables import append_receipts, measure, read_stored, replace_groups, stored
from pricetide.sinks.versions import VersionedTable
from pricetide.sources.manifests import manifest_files, stream_manifests
from pricetide.sources.snapshot_files import key_records, measure_keys
from pricetide.sources.snapshots import ALIASES, CATALOGUE_FIELDS, PRICE_FIELDS, explode_records, typed_records


@dataclass(frozen=True)
class NormalizedBatch:
    """Tables of one batch of landed days."""

    products: DataFrame
    sets: DataFrame
    variants: DataFrame
    prices: DataFrame
    quality: DataFrame
    unknown_categories: DataFrame
    duplicates: DataFrame
    invalid: DataFrame


def read_records(documents: DataFrame, fields: Iterable[str] = tuple(ALIASES)) -> DataFrame:
    """Typed records of snapshot documents (game_key, run_date, kind, body)."""
    return typed_records(explode_records(documents.select("game_key", "run_date", "kind", "body")), fields)


def normalize_documents(documents: DataFrame, categories: DataFrame) -> NormalizedBatch:
    """Normalise snapshot documents (game_key, run_date, kind, body) of any number of
    games and days in one plan; game and day are key columns."""
    catalogue = read_records(documents.filter(F.col("kind") == "catalogue"), CATALOGUE_FIELDS)
    return _normalize(
        normalize.catalogue_records(catalogue, categories),
        read_records(documents.filter(F.col("kind") == "priceguide"), PRICE_FIELDS),
        read_records(documents, ["cm_product_id"]),
    )


@dataclass(frozen=True)
class Records:
    """Typed records of documents, each kind with the fields that it has; a catalogue's are classified."""

    catalogue: DataFrame
    guide: DataFrame
    #: Those of any other kind, of which only the ids count.
    other: DataFrame

    def normalize(self, days: DataFrame | None = None) -> NormalizedBatch:
        """Tables of the records, or of those of some days (game_key, run_date)."""
        parts = [self.catalogue, self.guide, self.other]
        if days is not None:
            parts = [p.join(days, DAY, "left_semi") for p in parts]
        ids = [p.select(*DAY, "kind", "source_pos", "cm_product_id") for p in parts]
        return _normalize(parts[0], parts[1], ids[0].unionByName(ids[1]).unionByName(ids[2]))


def _normalize(catalogue: DataFrame, guide: DataFrame, records: DataFrame) -> NormalizedBatch:
    """Tables of the records of both kinds, the catalogue's being classified.

    `records` has the ids of these and of any other kind. The kind of a price row is that of
    its day's catalogue.
    """
    known = F.col("cm_product_id").isNotNull()
    catalogue, guide = catalogue.filter(known), guide.filter(known)
    products = normalize.products_table(catalogue)
    kinds = catalogue.select("game_key", "run_date", "cm_product_id", "product_kind")
    prices = normalize.prices_table(guide, kinds).select(*[f.name for f in PRICES.fields])
    duplicates = normalize.duplicate_keys(
        records, ["game_key", "run_date", "kind", "cm_product_id"]
    )
    return NormalizedBatch(
        products=products,
        sets=normalize.sets_table(catalogue),
        variants=normalize.variants_table(prices),
        prices=prices,
        quality=normalize.classification_coverage(catalogue),
        unknown_categories=normalize.unknown_categories(catalogue),
        duplicates=duplicates,
        invalid=records.filter(F.col("cm_product_id").isNull()).select(
            "game_key", "run_date", "kind", "source_pos"
        ),
    )


DAY = ["game_key", "run_date"]


@dataclass(frozen=True)
class Landed:
    """Documents of some days: what was measured of each, and how to read the records of some.

    `documents` has game_key, run_date, kind, key, sha256, size, valid, guide_records and
    other_records; `read` gives the typed records of the rows of it that it gets, with the fields
    that it is asked for.
    """

    documents: DataFrame
    read: Callable[[DataFrame, Iterable[str]], DataFrame]


def landed_bodies(bodies: DataFrame) -> Landed:
    """Landed documents from a table of bodies (game_key, run_date, kind, body)."""
    keyed = bodies.withColumn("key", snapshot_key(F.col("kind"), F.col("game_key"), F.col("run_date")))
    names = keyed.select("key", *DAY, "kind").distinct()

    def read(wanted: DataFrame, fields: Iterable[str]) -> DataFrame:
        return read_records(keyed.join(wanted.select("key"), "key", "left_semi"), fields)

    return Landed(measure_bodies(keyed).join(names, "key"), read)


def landed_files(files: DataFrame, root: str) -> Landed:
    """Landed documents that manifest entries (`files`) name below an archive's folder.

    No document becomes a value: files are measured and read as streams by the tasks.
    """
    listed = files.select("key", "game_key", F.col("run_date").cast("date").alias("run_date"), "kind").distinct()

    def read(wanted: DataFrame, fields: Iterable[str]) -> DataFrame:
        records = key_records(wanted.select("key", *DAY, "kind"), root)
        return typed_records(records.drop("key"), fields)

    return Landed(measured_files(measure_keys(listed, root)).join(listed, "key"), read)


def _rejected_by_manifest(files: DataFrame, documents: DataFrame, min_records: int) -> DataFrame:
    """(game, day) pairs whose manifest entries are duplicate, malformed, missing or don't fit what landed."""
    wrong = [structure_errors(files), compare_content(files, documents, min_records), duplicate_entries(files)]
    days = [w.select("game_key", F.col("run_date").cast("date").alias("run_date")) for w in wrong]
    listed = files.select("game_key", F.col("run_date").cast("date").alias("run_date"), "kind").distinct()
    unlisted = documents.select(*DAY, "kind").distinct().join(listed, [*DAY, "kind"], "left_anti").select(*DAY)
    kinds = listed.groupBy(*DAY).agg(F.count_distinct("kind").alias("kinds"))
    short = kinds.filter(F.col("kinds") < len(SOURCE_KINDS)).select(*DAY)
    out = unlisted.unionByName(short)
    for each in days:
        out = out.unionByName(each)
    return out.distinct()


#: Labels of a category map and days of a batch (one row a game and day) that are sent to every
#: task; more of them are joined by shuffles.
MAP_LABELS = 10_000
BATCH_DAYS = 100_000


def _sent(df: DataFrame, most: int) -> DataFrame:
    """`df`, to be broadcast by joins if it has at most `most` rows.

    Rows that come from a checkpoint or a local table have no size that a plan could tell, so the
    many rows on the other side would be shuffled by a label or a day, which few tasks would get.
    """
    return F.broadcast(df) if fits_broadcast(df, most) else df


def _stored_records(landed: Landed, documents: DataFrame, categories: DataFrame) -> Records:
    """The records of documents, parsed and classified once, each kind with its own fields."""
    categories = _sent(categories, MAP_LABELS)
    kind = F.col("kind")
    catalogue = landed.read(documents.filter(kind == "catalogue"), CATALOGUE_FIELDS)
    other = documents.filter(~F.coalesce(kind.isin(*SOURCE_KINDS), F.lit(False)))
    return Records(
        store(normalize.catalogue_records(catalogue, categories)),
        store(landed.read(documents.filter(kind == "priceguide"), PRICE_FIELDS)),
        store(landed.read(other, ["cm_product_id"])),
    )


def run_normalize(
    spark: SparkSession,
    landed: Landed,
    categories: DataFrame,
    root: str,
    files: DataFrame,
    min_records: int = MIN_PRICEGUIDE_RECORDS,
) -> DataFrame:
    """Merge a batch of landed documents into the tables below `root`.

    Every (game, day) is judged on its own. A day whose manifest entries (`files`) are
    malformed, incomplete or don't fit what landed is rejected before a record is read
    from it; a day with duplicate or missing ids or an empty catalogue is invalid. All
    other days are merged, whatever share of their categories is known. Only a day that
    reaches the share gets a completion row: the hashes of its sources and of the category
    map, its unknown categories, and rows and hash of every output that holds the day.
    Returns the run notes (one row per game and day): ok, fail (merged without completion),
    invalid or rejected; a completed day's note has its completion's fingerprint.

    Documents are parsed once; typed records are what is stored in between. Tables change by
    version, so a run that dies leaves each as it was, and can be repeated.
    """
    documents = cut_lineage(landed.documents)
    entries = files.withColumn("run_date", F.col("run_date").cast("date"))
    present = documents.select(*DAY).unionByName(entries.select(*DAY)).distinct()
    sources = documents.groupBy(*DAY).agg(
        *(F.max(F.when(F.col("kind") == kind, F.col("sha256"))).alias(f"{kind}_sha256") for kind in SOURCE_KINDS)
    )
    rejected = cut_lineage(_rejected_by_manifest(files, documents, min_records))
    records = _stored_records(landed, cut_lineage(documents.join(rejected, DAY, "left_anti")), categories)
    first = records.normalize()
    spoiled = first.duplicates.select(*DAY).unionByName(first.invalid.select(*DAY)).distinct()
    quality = (
        present.join(first.quality, DAY, "left")
        .join(spoiled.withColumn("spoiled", F.lit(True)), DAY, "left")
        .join(rejected.withColumn("rejected", F.lit(True)), DAY, "left")
        .select(
            *DAY,
            F.coalesce("catalogue_products", F.lit(0)).alias("catalogue_products"),
            F.coalesce("classification_coverage", F.lit(0.0)).alias("classification_coverage"),
            F.coalesce("unknown_products", F.lit(0)).alias("unknown_products"),
            F.when(F.col("rejected"), "rejected")
            .when(F.coalesce("spoiled", F.lit(False)) | F.col("status").isNull(), "invalid")
            .otherwise(F.col("status"))
            .alias("status"),
        )
    )
    quality = cut_lineage(quality)
    append_receipts(spark, f"{root}/quality", quality, DAY)
    merged = quality.filter(F.col("status").isin("pass", "fail")).select(*DAY)
    clean = records.normalize(_sent(merged, BATCH_DAYS))
    # Four outputs come from the prices, whose join and ids are worked out once.
    prices = store(clean.prices)
    unknown = cut_lineage(clean.unknown_categories.select(*DAY, "category"))
    replace_groups(spark, f"{root}/unknown_categories", unknown, merged)

    # Rows are dealt by the columns that their id is made of, which sort quicker, before they are
    # reduced: days rarely lie together, so a part reduction would sort all rows and drop few.
    product, variant = ["cm_product_id", "game_key"], ["cm_product_id", "game_key", "variant_key"]
    products = clean.products.repartition(*product)
    variants = normalize.variants_table(prices.repartition(*variant), distinct=False)
    tables = {
        "products": merge_catalogue_table(spark, f"{root}/products", products, PRODUCTS, "stable_product_id", product),
        "sets": merge_catalogue_table(spark, f"{root}/sets", clean.sets, SETS, "stable_set_id"),
        "variants": merge_catalogue_table(spark, f"{root}/variants", variants, VARIANTS, "stable_variant_id", variant),
        "prices": merge_price_partitions(spark, f"{root}/prices", prices),
    }
    # Read by the completions and by the notes. A variant's id is made of these columns.
    counts = cut_lineage(
        prices.groupBy("game_key", F.col("value_date").alias("run_date")).agg(
            F.count(F.lit(1)).alias("price_rows"),
            F.count_distinct("cm_product_id", "variant_key").alias("catalogue_variants"),
        )
    )
    notes = (
        quality.join(counts, DAY, "left")
        .join(sources, DAY, "left")
        .fillna(0, ["price_rows", "catalogue_variants"])
        .withColumn("status", F.when(F.col("status") == "pass", "ok").otherwise(F.col("status")))
    )
    _, map_hash = measure(categories)
    labels = unknown.groupBy(*DAY).agg(F.sort_array(F.collect_set("category")).alias("unknown_categories"))
    complete = (
        notes.filter(F.col("status") == "ok")
        .drop("status", "unknown_products")
        .withColumn("category_map_fingerprint", F.lit(map_hash))
        .join(labels, DAY, "left")
        .withColumn("unknown_categories", F.coalesce("unknown_categories", F.array().cast("array<string>")))
        .join(_outputs(spark, tables, merged), DAY)
    )
    complete = cut_lineage(complete)
    append_receipts(spark, f"{root}/completions", complete, DAY)
    prints = complete.select(*DAY, F.sha2(F.to_json(F.struct(*complete.columns)), 256).alias("completion_fingerprint"))
    stated = notes.drop(*(f"{kind}_sha256" for kind in SOURCE_KINDS)).join(prints, DAY, "left")
    return append_receipts(spark, f"{root}/runs", cut_lineage(stated), DAY)


def _outputs(spark: SparkSession, tables: dict[str, VersionedTable], days: DataFrame) -> DataFrame:
    """(game, day, outputs): each table's partitions that hold a day, with rows and additive hash.

    They come from the tables' versions; one row a partition, no data is read.
    """
    rows = [
        (values["game_key"], values.get("month"), f"{name}/{part.place}".rstrip("/"), part.rows, str(part.hash))
        for name, table in tables.items()
        for part in table.parts() or []
        for values in [table.values(part)]
    ]
    known = spark.createDataFrame(rows, struct("game_key string, month string, output string, rows bigint, hash string"))
    held = F.col("month").isNull() | (F.col("month") == F.date_format("run_date", "yyyy-MM"))
    listed = days.join(known, "game_key").filter(held)
    return listed.groupBy(*DAY).agg(F.sort_array(F.collect_list(F.struct("output", "rows", "hash"))).alias("outputs"))


def merge_catalogue_table(
    spark: SparkSession, path: str, current: DataFrame, schema: StructType, key: str, made_of: list[str] | None = None
) -> VersionedTable:
    """Merge a batch (possibly several days) into a stored catalogue table, game by game.

    `made_of` are columns that tell rows apart as `key` does, if it is made of them.
    """
    latest = cut_lineage(normalize.latest_catalogue(current, *(made_of or [key])))
    table = VersionedTable(spark, path, schema, ["game_key"], [key])
    # The games of a batch, as configured.
    games = [{"game_key": r["game_key"]} for r in latest.select("game_key").distinct().collect()]
    existing = table.read_partitions(games)
    if existing is not None:
        latest = merge.merge_catalogue(existing.select(*latest.columns), latest, key)
    table.replace_partitions(latest)
    return table


def merge_price_partitions(spark: SparkSession, path: str, current: DataFrame) -> VersionedTable:
    """Replace the touched (game, month) partitions by their merged rows.

    Only the months present in the batch are read and written anew.
    """
    month = F.date_format("value_date", "yyyy-MM").alias("month")
    incoming = current.select("*", month)
    table = VersionedTable(spark, path, PRICE_TABLE, ["game_key", "month"], ["cm_product_id", "variant_key", "value_date"])
    # Games x months of a batch: a calendar's worth at most.
    days = current.select("game_key", "value_date").distinct()
    touched = [r.asDict() for r in days.select("game_key", month).distinct().collect()]
    old = table.read_partitions(touched)
    table.replace_partitions(
        merge.merge_prices(incoming.limit(0) if old is None else old, incoming, table.order), dealt=True
    )
    return table


def backfill(
    spark: SparkSession,
    landed: Landed,
    files: DataFrame,
    categories: DataFrame,
    root: str,
    start: date,
    end: date,
    min_records: int = MIN_PRICEGUIDE_RECORDS,
) -> DataFrame:
    """Normalise all landed days of a range in one batch; status per calendar day.

    Days without a manifest and days that fail a gate are reported and do not stop
    the others.
    """
    if end < start:
        raise ValueError("end date must be on or after start date")
    inside = F.col("run_date").cast("date").between(F.lit(start), F.lit(end))
    cut = Landed(landed.documents.filter(inside), landed.read)
    run_normalize(spark, cut, categories, root, files.filter(inside), min_records)
    return backfill_status(spark, root, start, end)


def backfill_status(spark: SparkSession, root: str, start: date, end: date) -> DataFrame:
    """Status of each calendar day of a range, from the stored run notes."""
    from pricetide.operators.archive import backfill_summary, calendar_days

    days = calendar_days(spark.range(1), F.lit(start), F.lit(end))
    notes = read_stored(spark, f"{root}/runs").filter(F.col("run_date").between(F.lit(start), F.lit(end)))
    runs = notes.filter(F.col("status") == "ok").select("run_date")
    failed = notes.filter(F.col("status") != "ok").select("run_date")
    return backfill_summary(days, runs, failed)


def start_backfill(
    spark: SparkSession,
    archive_root: str,
    categories: DataFrame,
    root: str,
    checkpoint: str,
    start: date,
    end: date,
    days_per_batch: int = 31,
    min_records: int = MIN_PRICEGUIDE_RECORDS,
) -> StreamingQuery:
    """Backfill as a stream over the archive's manifests, which goes on where it stopped.

    Each micro-batch takes the next manifests of the range and merges their days; the stream's
    checkpoint knows which were taken. A batch that died is taken again, but leaves out days
    whose completion names the sources that their manifest names. Ends when no manifest is left.
    """
    if end < start:
        raise ValueError("end date must be on or after start date")

    def merge_batch(manifests: DataFrame, _: int) -> None:
        inside = manifests.filter(F.col("path_date").between(F.lit(start), F.lit(end)))
        files = cut_lineage(manifest_files(inside))
        done = stored(spark, f"{root}/completions")
        if done is not None:
            named = files.groupBy("game_key", F.col("run_date").try_cast("date").alias("run_date")).agg(
                *(F.max(F.when(F.col("kind") == k, F.col("sha256"))).alias(f"{k}_sha256") for k in SOURCE_KINDS)
            )
            same = cut_lineage(named.join(done.select(*named.columns), named.columns, "left_semi").select(*DAY))
            files = files.withColumn("_day", F.col("run_date").try_cast("date"))
            files = files.join(same.withColumnRenamed("run_date", "_day"), ["game_key", "_day"], "left_anti").drop("_day")
        if not files.isEmpty():
            run_normalize(spark, landed_files(files, archive_root), categories, root, files, min_records)

    return (
        stream_manifests(spark, f"{archive_root.rstrip('/')}/manifests", days_per_batch)
        .writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
