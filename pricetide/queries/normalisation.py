"""Snapshot parsing and normalisation queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import merge, normalize
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.sources import snapshots

_PRICE_RECORD = (
    "doc_key:i game_key:s run_date:s source_pos:i cm_product_id:i cm_category_id:i base_avg:f6 base_low:f6 base_avg7:f6 base_avg30:f6"
)


def _price_records(spark: SparkSession, sf: str, fields: Iterable[str] = snapshots.PRICE_FIELDS) -> DataFrame:
    return snapshots.typed_records(snapshots.explode_records(views.price_documents(spark, sf)), fields)


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    records = snapshots.typed_records(snapshots.explode_records(views.catalogue_documents(spark, sf)))
    return normalize.catalogue_records(records, views.categories(spark))


@query("snapshot_records", "S1 P11 F18", _PRICE_RECORD, "SELECT * FROM price_records", ["price_records"])
def snapshot_records(spark: SparkSession, sf: str) -> DataFrame:
    return _price_records(spark, sf, ("cm_product_id", "cm_category_id", "base_avg", "base_low", "base_avg7", "base_avg30"))


@query(
    "unknown_envelopes",
    "S1",
    "doc_key:i run_date:s",
    "SELECT l_orderkey AS doc_key, CAST(l_shipdate AS DATE) AS run_date FROM lineitem WHERE l_orderkey % 6 = 5",
)
def unknown_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.bad_envelopes(views.price_documents(spark, sf))


@query(
    "price_families",
    "P10",
    "doc_key:i game_key:s run_date:s cm_product_id:i variant_key:s price_low:f6 price_avg:f6 avg7:f6 avg30:f6",
    "SELECT * FROM price_rows",
    ["price_rows"],
)
def price_families(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.unpivot_prices(_price_records(spark, sf))


@query(
    "normalised_prices",
    "J1 F1 D6",
    "stable_variant_id:s stable_product_id:s game_key:s cm_product_id:i product_kind:s value_date:s variant_key:s price_low:f6 price_avg:f6",
    """SELECT 'cardmarket:' || r.game_key || ':product:' || r.cm_product_id || ':' || variant_key AS stable_variant_id,
    'cardmarket:' || r.game_key || ':product:' || r.cm_product_id AS stable_product_id, r.game_key, r.cm_product_id, coalesce(c.product_kind, 'other') AS product_kind,
    r.run_date AS value_date, variant_key, price_low, price_avg
    FROM price_rows r LEFT JOIN catalogue_records c ON c.game_key = r.game_key AND c.cm_product_id = r.cm_product_id""",
    ["price_rows", "catalogue_records"],
)
def normalised_prices(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.prices_table(_price_records(spark, sf), normalize.products_table(_catalogue(spark, sf)))


@query(
    "normalised_products",
    "D7 F1 F2 F3 S6",
    "stable_product_id:s game_key:s cm_product_id:i cm_expansion_id:i name:s product_kind:s raw_category:s source_date_added:s first_seen:s last_seen:s",
    """SELECT 'cardmarket:' || game_key || ':product:' || cm_product_id AS stable_product_id, *, run_date AS first_seen, run_date AS last_seen FROM catalogue_records""",
    ["catalogue_records"],
)
def normalised_products(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.products_table(_catalogue(spark, sf))


@query(
    "normalised_sets",
    "A15 D7",
    "stable_set_id:s game_key:s cm_expansion_id:i name:s first_seen:s",
    """SELECT 'cardmarket:' || game_key || ':expansion:' || cm_expansion_id AS stable_set_id, game_key, cm_expansion_id,
    coalesce((max(struct_pack(p := cm_product_id, n := expansion_name))).n, 'Expansion ' || cm_expansion_id) AS name, run_date AS first_seen
    FROM catalogue_records WHERE cm_expansion_id IS NOT NULL GROUP BY game_key, run_date, cm_expansion_id""",
    ["catalogue_records"],
)
def normalised_sets(spark: SparkSession, sf: str) -> DataFrame:
    # Documents hold one record each, so the product id orders the records of a day.
    return normalize.sets_table(_catalogue(spark, sf), "cm_product_id")


@query(
    "merged_sets",
    "A15 A13",
    "stable_set_id:s first_seen:s last_seen:s name:s",
    """SELECT 'cardmarket:' || game_key || ':expansion:' || cm_expansion_id AS stable_set_id, min(run_date) AS first_seen, max(run_date) AS last_seen,
    coalesce((max(struct_pack(d := run_date, p := cm_product_id, n := expansion_name))).n, 'Expansion ' || cm_expansion_id) AS name
    FROM catalogue_records WHERE cm_expansion_id IS NOT NULL GROUP BY game_key, cm_expansion_id""",
    ["catalogue_records"],
)
def merged_sets(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.latest_catalogue(normalize.sets_table(_catalogue(spark, sf), "cm_product_id"), "stable_set_id")


@query(
    "category_coverage",
    "A9",
    "game_key:s run_date:s catalogue_products:i unknown_products:i classification_coverage:f8 status:s",
    """SELECT game_key, run_date, count(*) AS catalogue_products, count(*) FILTER (NOT category_known) AS unknown_products, avg(CASE WHEN category_known THEN 1.0::DOUBLE ELSE 0 END) AS classification_coverage,
    CASE WHEN avg(CASE WHEN category_known THEN 1.0::DOUBLE ELSE 0 END) >= 0.99 THEN 'pass' ELSE 'fail' END AS status FROM catalogue_records GROUP BY 1, 2""",
    ["catalogue_records"],
)
def category_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.classification_coverage(_catalogue(spark, sf))


@query(
    "unknown_categories",
    "A10",
    "game_key:s run_date:s category:s",
    "SELECT DISTINCT game_key, run_date, CASE WHEN raw_category = '' THEN '(missing)' ELSE raw_category END AS category FROM catalogue_records WHERE NOT category_known",
    ["catalogue_records"],
)
def unknown_categories(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.unknown_categories(_catalogue(spark, sf))


@query(
    "distinct_variants",
    "A11",
    "stable_variant_id:s cm_product_id:i variant_key:s product_kind:s first_seen:s last_seen:s",
    """SELECT DISTINCT stable_variant_id, cm_product_id, variant_key, product_kind, value_date AS first_seen, value_date AS last_seen FROM price_panel""",
    ["price_panel"],
)
def distinct_variants(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.variants_table(views.price_panel(spark, sf))


@query(
    "duplicate_price_ids",
    "A12",
    "game_key:s run_date:s cm_product_id:i n:i",
    "SELECT game_key, run_date, cm_product_id, count(*) AS n FROM price_records GROUP BY 1, 2, 3 HAVING count(*) > 1",
    ["price_records"],
)
def duplicate_price_ids(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.duplicate_keys(_price_records(spark, sf, ["cm_product_id"]), ["game_key", "run_date", "cm_product_id"])


@query(
    "merged_catalogue",
    "A13",
    "stable_product_id:s name:s raw_category:s source_date_added:s first_seen:s last_seen:s",
    """SELECT 'cardmarket:' || game_key || ':product:' || pid AS stable_product_id,
    CASE WHEN in_new THEN name ELSE 'old ' || p_name END AS name, CASE WHEN in_new THEN raw_category ELSE 'OLD' END AS raw_category,
    CASE WHEN in_new THEN source_date_added ELSE '1990-01-01' END AS source_date_added,
    CASE WHEN in_old AND in_new THEN least(run_date, DATE '2001-01-02') WHEN in_old THEN DATE '2001-01-02' ELSE run_date END AS first_seen,
    CASE WHEN in_old AND in_new THEN greatest(run_date, DATE '2001-01-02') WHEN in_old THEN DATE '2001-01-02' ELSE run_date END AS last_seen
    FROM (SELECT p_partkey AS pid, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, p_partkey % 3 <> 0 AS in_old, c.cm_product_id IS NOT NULL AS in_new,
          c.name, c.raw_category, c.source_date_added, c.run_date FROM part LEFT JOIN catalogue_records c ON c.cm_product_id = p_partkey)
    WHERE in_old OR in_new""",
    ["catalogue_records"],
)
def merged_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import date

    current = normalize.products_table(_catalogue(spark, sf))
    pid = F.col("p_partkey")
    old = views.table(spark, sf, "part").filter(pid % 3 != 0).select(
        F.concat(F.lit("cardmarket:"), views.part_game(pid), F.lit(":product:"), pid.cast("string")).alias("stable_product_id"),
        views.part_game(pid).alias("game_key"),
        pid.alias("cm_product_id"),
        F.lit(7).cast("bigint").alias("cm_metacard_id"),
        F.lit(7).cast("bigint").alias("cm_category_id"),
        F.lit(7).cast("bigint").alias("cm_expansion_id"),
        F.concat(F.lit("old "), F.col("p_name")).alias("name"),
        F.lit("other").alias("product_kind"),
        F.lit("OLD").alias("raw_category"),
        F.lit("1990-01-01").alias("source_date_added"),
        F.lit(date(2001, 1, 2)).alias("first_seen"),
        F.lit(date(2001, 1, 2)).alias("last_seen"),
    )
    return merge.merge_catalogue(old, current, "stable_product_id")


@query(
    "replayed_price_days",
    "A14 ST2 U1",
    "cm_product_id:i variant_key:s value_date:s price_avg:f8 price_low:f8",
    """SELECT cm_product_id, variant_key, value_date, CASE WHEN month(value_date) % 2 = 0 THEN price_avg * 2 ELSE price_avg END AS price_avg,
    CASE WHEN month(value_date) % 2 = 1 THEN price_low END AS price_low FROM price_panel""",
    ["price_panel"],
)
def replayed_price_days(spark: SparkSession, sf: str) -> DataFrame:
    stored = views.price_panel(spark, sf)
    replay = (
        stored.filter(F.month("value_date") % 2 == 0)
        .withColumn("price_avg", F.col("price_avg") * 2)
        .drop("price_low")
    )
    return merge.merge_prices(stored, replay)


@query(
    "widened_union",
    "U1",
    "key:i amount:f4 balance:f4",
    """SELECT o_orderkey AS key, o_totalprice AS amount, NULL AS balance FROM orders UNION ALL SELECT c_custkey, c_custkey, c_acctbal FROM customer""",
)
def widened_union(spark: SparkSession, sf: str) -> DataFrame:
    left = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount")
    )
    right = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_custkey").alias("amount"), F.col("c_acctbal").alias("balance")
    )
    return merge.widen_union(left, right)


@query(
    "combined_catalogues",
    "U2 A25",
    "game_key:s run_date:s records:i version:i created_at:s payloads:i",
    """SELECT game_key, run_date, count(*) AS records, max(CASE WHEN product_kind = 'single' THEN 1 END) AS version,
    max(CASE WHEN product_kind = 'single' THEN '2001-01-01T0' || (cm_product_id % 7) ELSE '2001-01-01T0' || (cm_product_id % 9) END) AS created_at,
    count(DISTINCT product_kind = 'single') AS payloads FROM catalogue_records GROUP BY 1, 2""",
    ["catalogue_records"],
)
def combined_catalogues(spark: SparkSession, sf: str) -> DataFrame:
    rows = _catalogue(spark, sf)
    pid = F.col("cm_product_id")

    def payload(df: DataFrame, version: int, mod: int) -> DataFrame:
        stamp = F.concat(F.lit("2001-01-01T0"), (pid % mod).cast("string"))
        return df.withColumn("version", F.lit(version)).withColumn("created_at", stamp)

    singles = payload(rows.filter(F.col("product_kind") == "single"), 1, 7)
    others = payload(rows.filter(F.col("product_kind") != "single"), 2, 9)
    records, header = normalize.combine_catalogues(singles, others)
    counts = records.groupBy("game_key", "run_date").agg(F.count(F.lit(1)).alias("records"))
    return header.join(counts, ["game_key", "run_date"])


def _ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    line = views.table(spark, sf, "lineitem")
    prices = line.select(
        views.part_game(F.col("l_partkey")).alias("game_key"),
        F.to_date("l_shipdate").alias("run_date"),
        F.col("l_partkey").alias("cm_product_id"),
    )
    days = prices.select("game_key", "run_date", F.col("cm_product_id"), ).filter(F.col("cm_product_id") % 10 != 3)
    return prices, days.distinct()


@query(
    "source_checks",
    "D12 J9 U4 A12",
    "game_key:s run_date:s price_records:i catalogue_records:i matched_price_records:i duplicate_price_ids:i catalogue_coverage:f6 status:s",
    """SELECT game_key, run_date, count(*) AS price_records, count(*) FILTER (listed) AS catalogue_records, count(*) FILTER (listed) AS matched_price_records,
    count(*) FILTER (n > 1) AS duplicate_price_ids, round(count(*) FILTER (listed) / count(*)::DOUBLE, 6) AS catalogue_coverage,
    CASE WHEN count(*) FILTER (n > 1) = 0 AND count(*) FILTER (listed) / count(*)::DOUBLE >= 0.95 THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, CAST(l_shipdate AS DATE) AS run_date, l_partkey % 10 <> 3 AS listed, l_partkey, count(*) AS n
          FROM lineitem GROUP BY ALL) GROUP BY 1, 2""",
)
def source_checks(spark: SparkSession, sf: str) -> DataFrame:
    prices, listed = _ids(spark, sf)
    return normalize.source_check(prices, listed)


@query(
    "source_schema_checks",
    "D12 A30",
    "game_key:s run_date:s base_schema_present:b variant_schema_present:b missing_required:i no_price_family:i",
    """SELECT game_key, run_date, false AS base_schema_present, false AS variant_schema_present,
    CAST(sum(missing) AS BIGINT) AS missing_required, CAST(sum(bare) AS BIGINT) AS no_price_family
    FROM (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, CAST(l_shipdate AS DATE) AS run_date, 0 AS missing,
          CASE WHEN l_linestatus = 'O' OR (l_returnflag = 'R' AND l_tax <> 0) THEN 0 ELSE 1 END AS bare FROM lineitem WHERE l_orderkey % 6 <> 5
          UNION ALL SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END, CAST(l_shipdate AS DATE), 1, 1 FROM lineitem WHERE l_orderkey % 6 <> 5) GROUP BY 1, 2""",
)
def source_schema_checks(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.schema_check(snapshots.explode_records(views.price_documents(spark, sf)))


@query(
    "daily_normalisation",
    "D6 A9 A11 A13 A14",
    "game_key:s value_date:s price_rows:i variants:i kinds:i total_low:f4",
    """SELECT game_key, run_date AS value_date, count(*) AS price_rows, count(DISTINCT cm_product_id || variant_key) AS variants,
    1 AS kinds, sum(price_low) AS total_low FROM price_rows GROUP BY 1, 2""",
    ["price_rows"],
)
def daily_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.plans.daily import normalize_documents

    documents = views.price_documents(spark, sf).unionByName(views.catalogue_documents(spark, sf))
    batch = normalize_documents(documents, views.categories(spark))
    return batch.prices.groupBy("game_key", "value_date").agg(
        F.count(F.lit(1)).alias("price_rows"),
        F.count_distinct("stable_variant_id").alias("variants"),
        F.count_distinct(F.col("product_kind").isin("single", "sealed", "other")).alias("kinds"),
        F.sum("price_low").alias("total_low"),
    )


@query(
    "latest_source_times",
    "A25",
    "game_key:s created_at:s documents:i",
    """SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, '2001-01-01T00:00:00+0000' AS created_at,
    count(*) FILTER (l_orderkey % 6 <> 0) AS documents FROM lineitem GROUP BY 1""",
)
def latest_source_times(spark: SparkSession, sf: str) -> DataFrame:
    stamp = snapshots.envelope_field(F.col("body"), "createdAt")
    return views.price_documents(spark, sf).groupBy("game_key").agg(
        F.max(stamp).alias("created_at"), F.count(stamp).alias("documents")
    )


@query(
    "landed_record_counts",
    "A30 S1",
    "doc_key:i record_count:i verdict:s",
    """SELECT l_orderkey AS doc_key, CASE WHEN l_orderkey % 6 <> 5 THEN CASE WHEN l_orderkey % 2 = 0 THEN 3 ELSE 2 END END AS record_count,
    CASE WHEN l_orderkey % 6 = 5 THEN 'missing records' WHEN l_orderkey % 2 = 1 THEN 'below minimum' ELSE 'ok' END AS verdict FROM lineitem""",
)
def landed_record_counts(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.operators.archive import source_metadata

    return source_metadata(views.price_documents(spark, sf), min_records=3)


@query(
    "normalisation_run",
    "D6 A9 A14 K10",
    "game_key:s run_date:s status:s catalogue_products:i unknown_products:i price_rows:i complete:b outputs:i month_rows:i",
    """WITH listed AS (
      SELECT CASE WHEN p_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, DATE '2001-01-01' + (p_size % 3) AS run_date,
      p_size % 3 > 0 AND p_partkey % 9 = 0 AS unknown FROM part),
    days AS (
      SELECT game_key, run_date, count(*) AS products, count(*) FILTER (unknown) AS unknowns,
      CASE WHEN game_key = 'pokemon' AND run_date = DATE '2001-01-03' THEN 'invalid'
        WHEN count(*) FILTER (NOT unknown) >= 0.99 * count(*) THEN 'ok' ELSE 'fail' END AS status FROM listed GROUP BY 1, 2)
    SELECT game_key, run_date, status, products + (status = 'invalid')::INT AS catalogue_products, unknowns AS unknown_products,
    CASE WHEN status = 'invalid' THEN 0 ELSE products END AS price_rows, status = 'ok' AS complete, CASE WHEN status = 'ok' THEN 3 END AS outputs,
    CASE WHEN status = 'ok' THEN sum(CASE WHEN status <> 'invalid' THEN products ELSE 0 END) OVER (PARTITION BY game_key) END AS month_rows FROM days""",
)
def normalisation_run(spark: SparkSession, sf: str) -> DataFrame:
    """The daily job over files and their manifests: a day that passes, days that fail, a day with an id twice."""
    from pricetide.plans.daily import landed_files, run_normalize
    from pricetide.sinks.tables import read_stored
    from pricetide.sources.manifests import manifest_files, read_manifests

    part, pid = views.table(spark, sf, "part"), F.col("p_partkey")
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_size") % 3).cast("int"))
    game = views.part_game(pid)
    label = F.when((F.col("p_size") % 3 > 0) & (pid % 9 == 0), "Strange").otherwise("Small\t")

    def records(rows: DataFrame, kind: str, record: F.Column) -> DataFrame:
        return rows.select(game.alias("game_key"), day.alias("run_date"), F.lit(kind).alias("kind"), pid.alias("n"), F.to_json(record).alias("text"))

    listed = F.struct(pid.alias("idProduct"), F.col("p_name").alias("name"), label.alias("categoryName"))
    priced = F.struct(pid.alias("idProduct"), F.col("p_retailprice").alias("avg"))
    spoiled = part.filter((pid % 2 == 1) & (F.col("p_size") % 3 == 2))
    again = spoiled.join(spoiled.agg(F.min(pid).alias("p_partkey")), "p_partkey", "left_semi")
    landed = (
        records(part, "catalogue", listed)
        .unionByName(records(again, "catalogue", listed))
        .unionByName(records(part, "priceguide", priced))
    )
    archive, root = views.write_archive(spark, landed), views.scratch(spark)
    files = manifest_files(read_manifests(spark, f"{archive}/manifests"))
    notes = run_normalize(spark, landed_files(files, archive), views.categories(spark), root, files, min_records=1)
    done = read_stored(spark, f"{root}/completions").select(
        "game_key", "run_date", F.lit(True).alias("complete"), F.size("outputs").alias("outputs"), F.aggregate("outputs", F.lit(0).cast("bigint"), lambda n, o: n + F.when(o["output"].startswith("prices/"), o["rows"]).otherwise(0)).alias("month_rows")
    )
    return notes.join(done, ["game_key", "run_date"], "left").fillna(False, ["complete"])


@query(
    "source_rules",
    "D12 A30",
    "game_key:s kind:s rule:s n:i source_created_at:s",
    """WITH d AS (
      SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key,
      CASE WHEN o_custkey % 2 = 0 THEN 'priceguide' ELSE 'catalogue' END AS kind, o_orderkey % 10 AS c FROM orders),
    broken AS (
      SELECT game_key, kind, CASE c WHEN 1 THEN 'not an object' WHEN 2 THEN 'no createdAt' WHEN 3 THEN 'no version' WHEN 4 THEN 'no list'
        WHEN 5 THEN 'empty list' WHEN 6 THEN 'record is not an object' WHEN 7 THEN 'id is not a whole number'
        WHEN 8 THEN CASE kind WHEN 'priceguide' THEN 'record without idCategory' ELSE 'record without categoryName, idCategory' END
        WHEN 9 THEN 'no createdAt' END AS rule FROM d)
    SELECT game_key, kind, rule, count(*) AS n, any_value(stamp) AS source_created_at FROM broken JOIN (
      SELECT game_key, max(CASE WHEN c NOT IN (1, 2, 9) THEN '2001-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0')
        WHEN c = 9 THEN '7' END) AS stamp FROM d GROUP BY 1) USING (game_key) WHERE rule IS NOT NULL GROUP BY 1, 2, 3""",
)
def source_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A source document per order; nine in ten break a rule, each another by the last digit."""
    key = F.col("o_orderkey")
    digit = key % 10
    guide = F.col("o_custkey") % 2 == 0
    stamp = F.concat(F.lit('"createdAt": "2001-01-'), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit('", '))
    created = F.when(digit == 2, "").when(digit == 9, '"createdAt": 7, ').otherwise(stamp)
    version = F.when(digit == 3, "").otherwise('"version": 1, ')
    number = F.when(digit == 7, F.concat(F.lit('"'), key.cast("string"), F.lit('"'))).otherwise(key.cast("string"))
    rest = F.when(digit == 8, "").otherwise(F.when(guide, ', "idCategory": 3').otherwise(', "idCategory": 3, "categoryName": "c"'))
    name = F.when(guide, "").otherwise(', "name": "n"')
    record = F.concat(F.lit('{"idProduct": '), number, name, rest, F.lit("}"))
    records = F.when(digit == 5, "").when(digit == 6, "5").otherwise(record)
    member = F.when(digit == 4, "other").when(guide, "priceGuides").otherwise("products")
    whole = F.concat(F.lit("{"), created, version, F.lit('"'), member, F.lit('": ['), records, F.lit("]}"))
    documents = views.table(spark, sf, "orders").select(
        F.when(key % 2 == 0, "onepiece").otherwise("pokemon").alias("game_key"),
        F.lit("2001-01-01").cast("date").alias("run_date"),
        F.when(guide, "priceguide").otherwise("catalogue").alias("kind"),
        F.when(digit == 1, F.concat(F.lit("["), record, F.lit("]"))).otherwise(whole).alias("body"),
    )
    rules = normalize.source_rules(documents)
    return rules.join(normalize.newest_source(documents), ["game_key", "run_date"])
