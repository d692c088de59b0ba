"""Catalogue and price normalisation of typed snapshot records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.ids import product_id, set_id, variant_id
from pricetide.functions.text import label_key, source_date, strip
from pricetide.params import HOLO_GAMES

# Fixed value: smallest share of products whose category must be known.
MIN_CLASSIFICATION = 0.99
DOCUMENT = ["game_key", "run_date"]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def classify(records: DataFrame, categories: DataFrame) -> DataFrame:
    """Add product_kind (default `other`) and whether the category is known.

    The category map is a configuration file of at most a few hundred labels.
    """
    labels = (
        categories.select(F.col("label").alias("_label"), F.col("kind").alias("_kind"))
    )
    return (
        records.withColumn("_key", label_key(F.col("raw_category")))
        .join(labels, F.col("_key") == F.col("_label"), "left")
        .withColumn("product_kind", F.coalesce("_kind", F.lit("other")))
        .withColumn("category_known", F.col("_kind").isNotNull())
        .drop("_key", "_label", "_kind")
    )


def catalogue_records(records: DataFrame, categories: DataFrame) -> DataFrame:
    """Records with trimmed category and classification; input of the tables below."""
    trimmed = records.withColumn(
        "raw_category", strip(F.coalesce("raw_category", F.lit("")))
    )
    return classify(trimmed, categories)


def products_table(classified: DataFrame) -> DataFrame:
    game, pid = F.col("game_key"), F.col("cm_product_id")
    return classified.select(
        product_id(game, pid).alias("stable_product_id"),
        "game_key",
        "cm_product_id",
        "cm_metacard_id",
        "cm_category_id",
        "cm_expansion_id",
        F.coalesce("name", F.concat(F.lit("Product "), pid.cast("string"))).alias("name"),
        "product_kind",
        "raw_category",
        source_date(F.col("date_added")).alias("source_date_added"),
        F.col("run_date").alias("first_seen"),
        F.col("run_date").alias("last_seen"),
    )


def sets_table(classified: DataFrame, position: str = "source_pos") -> DataFrame:
    """One row per expansion; the last record of the document names it."""
    named = classified.filter(F.col("cm_expansion_id").isNotNull())
    last = F.max_by(F.struct("expansion_name", "release_date"), position)
    expansion = F.col("cm_expansion_id")
    return (
        named.groupBy(*DOCUMENT, "cm_expansion_id")
        .agg(last.alias("last"))
        .select(
            set_id(F.col("game_key"), expansion).alias("stable_set_id"),
            "game_key",
            "cm_expansion_id",
            F.coalesce(
                "last.expansion_name", F.concat(F.lit("Expansion "), expansion.cast("string"))
            ).alias("name"),
            F.col("last.release_date").alias("release_date"),
            F.col("run_date").alias("first_seen"),
            F.col("run_date").alias("last_seen"),
        )
    )


def classification_coverage(classified: DataFrame) -> DataFrame:
    """Category quality per game and day: coverage, number of unknown rows, pass or fail."""
    return (
        classified.groupBy(*DOCUMENT)
        .agg(
            F.count(F.lit(1)).alias("catalogue_products"),
            F.avg(F.col("category_known").cast("double")).alias("coverage"),
            F.count_if(~F.col("category_known")).alias("unknown_products"),
        )
        .withColumn("status", F.when(F.col("coverage") >= MIN_CLASSIFICATION, "pass").otherwise("fail"))
        .withColumn("classification_coverage", F.round("coverage", 8))
        .drop("coverage")
    )


def unknown_categories(classified: DataFrame) -> DataFrame:
    """Distinct unknown category labels per game and day; a blank label is `(missing)`."""
    label = F.when(F.col("raw_category") == "", "(missing)").otherwise(F.col("raw_category"))
    return (
        classified.filter(~F.col("category_known"))
        .select(*DOCUMENT, label.alias("category"))
        .distinct()
    )


def _family(prefix: str, variant: Column) -> Column:
    return F.struct(
        variant.alias("variant_key"),
        F.col(f"{prefix}_low").alias("price_low"),
        F.col(f"{prefix}_avg").alias("price_avg"),
        F.col(f"{prefix}_avg1").alias("avg1"),
        F.col(f"{prefix}_avg7").alias("avg7"),
        F.col(f"{prefix}_avg30").alias("avg30"),
    )


def unpivot_prices(records: DataFrame) -> DataFrame:
    """One row per price family that has an average or a low price.

    Games listed in HOLO_GAMES publish their second finish as `holo`; either
    finish becomes the variant `foil`.
    """
    holo = F.col("game_key").isin(*HOLO_GAMES)
    second = F.when(holo, _family("holo", F.lit("foil"))).otherwise(_family("foil", F.lit("foil")))
    families = F.array(_family("base", F.lit("nonfoil")), second)
    priced = F.filter(
        families, lambda f: f["price_avg"].isNotNull() | f["price_low"].isNotNull()
    )
    return records.withColumn("f", F.explode(priced)).select(
        *[c for c in records.columns if not c.startswith(("base_", "foil_", "holo_"))], "f.*"
    )


def with_product_kind(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Look up product_kind by game and product; unknown products are `other`.

    Where both sides have a `run_date` the day is part of the key. A product that is
    listed more than once has the last of its kinds by name, so no row is doubled.
    """
    days = ["run_date"] if "run_date" in rows.columns and "run_date" in products.columns else []
    # The greatest kind of texts is found by sorting, which is quicker by ids first.
    key = ["cm_product_id", "game_key", *days]
    listed = products.select(*key, "product_kind")
    if days:
        # A day lists a product once, so nothing is reduced before the shuffle that the join needs.
        # Files of few bytes hold very many such rows, too many to be sent to every task.
        listed, rows = listed.repartition(*key), rows.hint("merge")
    kinds = listed.groupBy(*key).agg(F.max("product_kind").alias("_kind"))
    return (
        rows.join(kinds, key, "left")
        .withColumn("product_kind", F.coalesce("_kind", F.lit("other")))
        .drop("_kind")
    )


def prices_table(records: DataFrame, products: DataFrame) -> DataFrame:
    """Normalised price rows of one or more snapshot days."""
    game, pid = F.col("game_key"), F.col("cm_product_id")
    return with_product_kind(unpivot_prices(records), products).select(
        variant_id(game, pid, F.col("variant_key")).alias("stable_variant_id"),
        product_id(game, pid).alias("stable_product_id"),
        "game_key",
        "cm_product_id",
        "cm_category_id",
        "product_kind",
        F.col("run_date").alias("value_date"),
        "variant_key",
        "price_low",
        "price_avg",
        "avg1",
        "avg7",
        "avg30",
    )


def variants_table(prices: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct variant identities of each day, seen on that day.

    Without `distinct` they repeat as the prices do, for a caller that reduces them by id.
    """
    variants = prices.select(
        "stable_variant_id",
        "stable_product_id",
        "game_key",
        "cm_product_id",
        "variant_key",
        "product_kind",
        "value_date",
    )
    return (
        (variants.distinct() if distinct else variants)
        .withColumn("first_seen", F.col("value_date"))
        .withColumnRenamed("value_date", "last_seen")
    )


def combine_catalogues(singles: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union the two catalogue payloads of each game.

    Inputs are typed records with `version` and `created_at` of their payload.
    Returns (records, header); the header takes the version of the singles and the
    later creation time (compared as text).
    """
    both = singles.withColumn("_part", F.lit(0)).unionByName(others.withColumn("_part", F.lit(1)))
    header = both.groupBy(*DOCUMENT).agg(
        F.max_by("version", F.when(F.col("_part") == 0, F.lit(1))).alias("version"),
        F.max("created_at").alias("created_at"),
        F.count_distinct("_part").alias("payloads"),
    )
    return both.drop("_part", "version", "created_at"), header


def latest_catalogue(tables: DataFrame, *keys: str) -> DataFrame:
    """Collapse several days of a catalogue table: attributes of the last day,
    first_seen and last_seen over all days."""
    rest = [c for c in tables.columns if c not in (*keys, "first_seen", "last_seen")]
    return (
        tables.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), "last_seen").alias("_last"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], "first_seen", "last_seen")
        .select(*tables.columns)
    )


def source_check(prices: DataFrame, products: DataFrame, min_coverage: float = 0.95) -> DataFrame:
    """Per game and day: record counts, duplicate ids, id coverage and pass/fail.

    Inputs are id rows (game_key, run_date, cm_product_id). Distinct ids of both
    sides meet in one aggregation, so no side is collected.
    """
    sides = prices.select(*DOCUMENT, "cm_product_id", F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        products.select(*DOCUMENT, "cm_product_id", F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    ids = sides.groupBy(*DOCUMENT, "cm_product_id").agg(
        F.sum("p").alias("p"), F.sum("c").alias("c")
    )
    out = ids.groupBy(*DOCUMENT).agg(
        F.count_if(F.col("p") > 0).alias("price_records"),
        F.count_if(F.col("c") > 0).alias("catalogue_records"),
        F.count_if((F.col("p") > 0) & (F.col("c") > 0)).alias("matched_price_records"),
        F.count_if(F.col("p") > 1).alias("duplicate_price_ids"),
        F.count_if(F.col("c") > 1).alias("duplicate_catalogue_ids"),
        F.count_if(F.col("cm_product_id").isNull()).alias("missing_ids"),
    )
    coverage = F.try_divide(F.col("matched_price_records"), F.col("price_records"))
    clean = (
        (F.col("duplicate_price_ids") == 0)
        & (F.col("duplicate_catalogue_ids") == 0)
        & (F.col("missing_ids") == 0)
        & (F.col("price_records") > 0)
        & (F.col("catalogue_records") > 0)
    )
    return out.withColumn("catalogue_coverage", F.round(F.coalesce(coverage, F.lit(0.0)), 6)).withColumn(
        "status",
        F.when(clean & (coverage >= min_coverage), "pass").otherwise("fail"),
    )


def schema_check(records: DataFrame) -> DataFrame:
    """Per game and day: does any record carry the full base and variant price fields,
    and how many records have no price family at all. Input: raw `item` texts."""
    fields = F.json_object_keys("item")

    def has(*names: str) -> Column:
        return F.size(F.array_intersect(fields, F.array(*[F.lit(n) for n in names]))) == len(names)

    holo = F.col("game_key").isin(*HOLO_GAMES)
    second_avg = F.when(holo, has("avg-holo")).otherwise(has("avg-foil"))
    second = F.when(holo, has("avg-holo", "low-holo")).otherwise(has("avg-foil", "low-foil"))
    return records.groupBy(*DOCUMENT).agg(
        F.bool_or(has("avg", "low", "avg1", "avg7", "avg30")).alias("base_schema_present"),
        F.bool_or(second).alias("variant_schema_present"),
        F.count_if(~has("idProduct", "idCategory")).alias("missing_required"),
        F.count_if(~(has("avg") | second_avg)).alias("no_price_family"),
    )



# The list that a source document of a kind holds, and the fields of its records.
SOURCE_LISTS = {"priceguide": "priceGuides", "catalogue": "products"}
SOURCE_FIELDS = {
    "priceguide": ("idProduct", "idCategory"),
    "catalogue": ("idProduct", "name", "idCategory", "categoryName"),
}


def source_rules(documents: DataFrame) -> DataFrame:
    """Broken rules of source documents (game_key, run_date, kind, body), how often each.

    A row (game_key, run_date, kind, rule, n). A document must be an object with `createdAt` (a
    text), `version` and its kind's list; the list's records must be objects with a whole-number
    id and all fields of the kind; a list may not be empty.
    """
    parsed = F.try_parse_json("body")

    def type_of(value: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, path, "variant"))

    created = F.get_json_object("body", "$.createdAt")
    listed = F.coalesce(*[F.when(F.col("kind") == k, F.try_variant_get(parsed, f"$.{m}", "array<variant>")) for k, m in SOURCE_LISTS.items()])
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    docs = documents.select(
        *DOCUMENT,
        "kind",
        listed.alias("list"),
        F.array_compact(
            F.array(
                F.when(~is_object, "not an object"),
                F.when(is_object & ~F.coalesce((type_of(parsed, "$.createdAt") == "STRING") & (created != ""), F.lit(False)), "no createdAt"),
                F.when(is_object & ~F.array_contains(F.json_object_keys("body"), "version"), "no version"),
                F.when(is_object & listed.isNull(), "no list"),
                F.when(is_object & (F.size(listed) == 0), "empty list"),
            )
        ).alias("rules"),
    )
    of_documents = docs.select(*DOCUMENT, "kind", F.explode("rules").alias("rule"))
    # Records of an unknown kind have no rules, and a document without a list has no records.
    items = docs.select(*DOCUMENT, "kind", F.explode("list").alias("v")).withColumn("item", F.to_json("v"))
    record = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    fields = F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>"))
    wanted = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, names))) for k, names in SOURCE_FIELDS.items()])
    missing = F.array_sort(F.array_except(wanted, fields))
    whole = F.coalesce(type_of(F.col("v"), "$.idProduct") == "BIGINT", F.lit(False))
    of_records = items.select(
        *DOCUMENT,
        "kind",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~record, "record is not an object"),
                    F.when(record & ~whole, "id is not a whole number"),
                    F.when(record & (F.size(missing) > 0), F.concat(F.lit("record without "), F.array_join(missing, ", "))),
                )
            )
        ).alias("rule"),
    )
    return of_documents.unionByName(of_records).groupBy(*DOCUMENT, "kind", "rule").agg(F.count(F.lit(1)).alias("n"))


def newest_source(documents: DataFrame) -> DataFrame:
    """Per game and day the latest `createdAt` (compared as text) of all its documents."""
    return documents.groupBy(*DOCUMENT).agg(F.max(F.get_json_object("body", "$.createdAt")).alias("source_created_at"))
