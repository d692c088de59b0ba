"""Price-guide and catalogue snapshots: whole JSON documents to typed records.

A snapshot document is read as text, so that one stray element cannot spoil the
document, and its records become rows at once: everything after the envelope
runs per record.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricetide.functions.ids import NAMESPACE
from pricetide.functions.text import first_present

# Envelope members that may hold the record list, in order of
# preference, and the alias names under which a field may arrive.
ENVELOPE_MEMBERS = ("data", "products", "priceGuide", "priceGuides")
ALIASES = {
    "cm_product_id": ("idProduct", "productId", "cm_product_id", "id"),
    "cm_expansion_id": ("idExpansion", "expansionId", "cm_expansion_id"),
    "cm_metacard_id": ("idMetacard",),
    "cm_category_id": ("idCategory",),
    "raw_category": ("categoryName", "category", "productType", "type"),
    "name": ("name", "productName"),
    "expansion_name": ("expansionName", "setName", "set"),
    "release_date": ("releaseDate", "dateRelease"),
    "date_added": ("dateAdded",),
    "base_avg": ("avg", "price_avg", "avgPrice", "average"),
    "base_low": ("low", "price_low", "lowPrice"),
    "base_avg1": ("avg1", "avg1Price"),
    "base_avg7": ("avg7", "avg7Price"),
    "base_avg30": ("avg30", "avg30Price"),
    "foil_avg": ("avg-foil", "foilAvg", "priceFoil"),
    "foil_low": ("low-foil", "foilLow"),
    "foil_avg1": ("avg1-foil",),
    "foil_avg7": ("avg7-foil",),
    "foil_avg30": ("avg30-foil",),
    "holo_avg": ("avg-holo", "foilAvg", "priceFoil"),
    "holo_low": ("low-holo", "foilLow"),
    "holo_avg1": ("avg1-holo",),
    "holo_avg7": ("avg7-holo",),
    "holo_avg30": ("avg30-holo",),
}

_LONG = ("cm_product_id", "cm_expansion_id", "cm_metacard_id", "cm_category_id")
_TEXT = ("raw_category", "name", "expansion_name", "release_date", "date_added")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per (gzip) JSON file: path, kind, game, run_date taken from the key, and text."""
    key = F.regexp_extract(
        F.col("path"), NAMESPACE + r"/([a-z]+)/([a-z0-9]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})", 0
    )
    part = F.split(key, "/")
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
        .withColumn("kind", F.get(part, F.lit(1)))
        .withColumn("game_key", F.get(part, F.lit(2)))
        .withColumn("run_date", F.get(part, F.lit(5)).try_cast("date"))
    )


def record_list(body: Column) -> Column:
    """The document's record list as an array of JSON texts; NULL for an unknown envelope."""
    # One pass over the document reads whichever members are lists (others become
    # NULL); their elements keep their JSON text.
    envelope = F.from_json(body, ", ".join(f"{name} array<string>" for name in ENVELOPE_MEMBERS))

    def first_list(e: Column) -> Column:
        return F.coalesce(*[e.getField(name) for name in ENVELOPE_MEMBERS])

    # Going through a lambda binds the parsed document once; as plain field accesses
    # each member would parse the document again.
    listed = F.get(F.transform(F.array(envelope), first_list), F.lit(0))
    bare = F.ltrim(body).startswith("[")
    return F.when(bare, F.from_json(body, "array<string>")).otherwise(listed)


def envelope_field(body: Column, name: str) -> Column:
    return F.get_json_object(body, f"$.{name}")


def explode_records(documents: DataFrame) -> DataFrame:
    """One row per JSON object of each document (other list elements are dropped).

    `documents` has a `body` column; the remaining columns are kept. `source_pos`
    is the record's place in its document.
    """
    keep = [c for c in documents.columns if c != "body"]
    return (
        documents.select(*keep, F.posexplode(record_list(F.col("body"))).alias("source_pos", "item"))
        .filter(F.ltrim("item").startswith("{"))
    )


def bad_envelopes(documents: DataFrame) -> DataFrame:
    """Documents whose JSON shape is not one of the known envelopes."""
    return documents.filter(record_list(F.col("body")).isNull()).drop("body")


#: Fields of the records of each kind.
CATALOGUE_FIELDS = (*_LONG, *_TEXT)
PRICE_FIELDS = ("cm_product_id", "cm_category_id", *(n for n in ALIASES if n.startswith(("base_", "foil_", "holo_"))))


def _record_schema(fields: Iterable[str]) -> StructType:
    names = sorted({alias for name in fields for alias in ALIASES[name]})
    return StructType([StructField(n, StringType()) for n in names])


def typed_records(records: DataFrame, fields: Iterable[str] = tuple(ALIASES)) -> DataFrame:
    """Resolve the alias names of `fields` (by default all) and coerce ids and prices.

    Members of a record that no field asks for are skipped by the parser.
    """
    fields = tuple(fields)
    parsed = records.withColumn("r", F.from_json("item", _record_schema(fields))).drop("item")

    def pick(name: str) -> Column:
        return first_present(*[F.col("r").getField(alias) for alias in ALIASES[name]])

    columns = []
    for name in fields:
        value = pick(name)
        if name in _LONG:
            value = value.try_cast("bigint")
        elif name not in _TEXT:
            value = value.try_cast("double")
        columns.append(value.alias(name))
    keep = [F.col(c) for c in parsed.columns if c != "r"]
    return parsed.select(*keep, *columns)
