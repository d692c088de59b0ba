"""The engine's input tables derived from the driver tables, in Spark and in SQL.

Each Spark view has a SQL twin of the same name in `SQL`; `sql(name, ...)`
composes the WITH clause a query needs.
"""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from pricetide.functions.hashing import content_sha
from pricetide.functions.ids import product_id, set_id, snapshot_key, variant_id
from pricetide.operators import chain, membership, selection
from pricetide.params import IndexDefinition, Methodology, definitions_frame, literal_table
from pricetide.schemas import struct
from pricetide.session import ensure_checkpoint_dir
from pricetide.sources.categories import category_frame

METHOD = Methodology(
    seasoning_days=90,
    min_history_days=8,
    min_observation_ratio=0.10,
    price_floor_observation_ratio=0.10,
    max_suspect_zero_ratio=0.05,
    selection_lookback_days=60,
    min_price_eur={"singles": 5.0, "sealed": 10.0},
    indexes=(
        IndexDefinition("ONS8", "One Singles 8", "onepiece", "singles", 8, date(1995, 3, 1), 1000.0, "published"),
        IndexDefinition("ONB2", "One Sealed 2", "onepiece", "sealed", 2, date(1995, 3, 1), 1000.0, "accumulating"),
        IndexDefinition("PKS8", "Poke Singles 8", "pokemon", "singles", 8, date(1995, 6, 1), 500.0, "published", ("EN",)),
        IndexDefinition("PKB3", "Poke Sealed 3", "pokemon", "sealed", 3, date(1995, 3, 1), 1000.0, "draft"),
    ),
)
CATEGORY_LABELS = {
    "single": ["STANDARD", "  medium ", "Small"],
    "sealed": ["Promo", "LARGE"],
    "other": ["misc"],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by a hash of `keys` to the session's number of shuffle partitions.

    A given table may be one row group, so one task; texts are built and parsed behind this.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by(*keys: str) -> WindowSpec:
    """A window over all rows of the same keys."""
    return Window.partitionBy(*keys)


def scratch(spark: SparkSession) -> str:
    """A fresh folder for tables a query writes and reads back, in the shared checkpoint folder."""
    shared = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{shared}/tables-{uuid4().hex}"


def write_archive(
    spark: SparkSession, records: DataFrame, sha: Column | None = None, root: str | None = None
) -> str:
    """Write records (game_key, run_date, kind, n, text) as snapshot files and manifests.

    Returns the archive's folder. A file is written line by line, a record a line in order of
    `n`. `sha` replaces the hash that manifests declare.
    """
    from pricetide.session import cut_lineage
    from pricetide.sources.object_files import write_objects
    from pricetide.sources.snapshot_files import with_key

    def envelope(key: str) -> tuple[str, str]:
        kind, day = key.split("/")[1], key.rpartition("/")[2][:10]
        member = "products" if kind == "catalogue" else "priceGuides"
        return f'{{"version": 1, "createdAt": "{day}", "{member}": [', "]}"

    root = root or scratch(spark)
    key = snapshot_key(F.col("kind"), F.col("game_key"), F.col("run_date"))
    lines = records.select(key.alias("key"), F.col("n").alias("pos"), "text")
    # Writing is the action here, so it is run once; the files' names give the other columns.
    written = cut_lineage(with_key(write_objects(lines, root, envelope).withColumnRenamed("key", "path")))
    entry = F.struct(
        F.col("game_key").alias("game"),
        "kind",
        "key",
        (F.col("sha256") if sha is None else sha).alias("sha256_uncompressed"),
        F.col("size").alias("size_uncompressed"),
        F.concat(F.col("run_date").cast("string"), F.lit("T05:00:00+00:00")).alias("fetched_at"),
    )
    listed = written.groupBy("run_date").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    manifest = F.to_json(F.struct(F.col("run_date").cast("string").alias("run_date"), F.lit(1).alias("schema_version"), "files"))
    key = F.concat(F.lit("manifests/"), F.col("run_date").cast("string"), F.lit(".json"))
    write_objects(listed.select(key.alias("key"), F.lit(0).alias("pos"), manifest.alias("text")), root).count()
    return root


def monthly_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a price guide and a catalogue for each game and month of line items."""
    return listing_records(monthly_sales(spark, sf))


def monthly_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's highest price and name by game and month of line items."""
    pid, month = F.col("l_partkey"), F.trunc(F.to_date("l_shipdate"), "MM")
    line = spread(table(spark, sf, "lineitem"), "l_partkey")
    sold = line.groupBy(pid.alias("pid"), month.alias("run_date")).agg(F.max("l_extendedprice").alias("avg"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), "p_name", "p_type")
    return sold.join(part, "pid").withColumn("game_key", part_game(F.col("pid")))


def listing_records(sales: DataFrame) -> DataFrame:
    """The price guides' and the catalogues' records of monthly sales."""
    guide = F.to_json(F.struct(F.col("pid").alias("idProduct"), F.lit(1).alias("idCategory"), "avg"))
    listed = F.to_json(F.struct(F.col("pid").alias("idProduct"), F.col("p_name").alias("name"), F.lit("Small").alias("categoryName")))
    kinds = F.explode(F.array(F.struct(F.lit("priceguide").alias("kind"), guide.alias("text")), F.struct(F.lit("catalogue").alias("kind"), listed.alias("text"))))
    return sales.select("game_key", "run_date", F.col("pid").alias("n"), kinds.alias("r")).select("game_key", "run_date", "n", "r.*")


def definitions(spark: SparkSession) -> DataFrame:
    return definitions_frame(spark, METHOD)


def categories(spark: SparkSession) -> DataFrame:
    return category_frame(spark, CATEGORY_LABELS)


def brand_id(brand: Column) -> Column:
    return F.regexp_extract(brand, r"#(\d+)", 1).cast("bigint")


def game_of(pid: Column) -> Column:
    return F.when(pid % 2 == 0, "onepiece").otherwise("pokemon")


def kind_of(pid: Column) -> Column:
    return F.when(pid <= 20, "single").otherwise("sealed")


def variant_of(flag: Column) -> Column:
    return F.when(flag == "R", "foil").otherwise("nonfoil")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the brand as product and the variant by return flag."""
    part = table(spark, sf, "part").select(
        "p_partkey", "p_retailprice", brand_id(F.col("p_brand")).alias("cm_product_id")
    )
    line = table(spark, sf, "lineitem").select(
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_linestatus",
        variant_of(F.col("l_returnflag")).alias("variant_key"),
        F.to_date("l_shipdate").alias("value_date"),
    )
    return line.join(part, line.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")


def price_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily prices per brand and variant.

    Averages are taken over decimals, whose sums don't depend on the order of rows.
    """
    price = F.when(
        F.col("variant_key") == "foil", F.col("l_extendedprice") / F.col("l_quantity")
    ).otherwise(F.col("p_retailprice") * (1 - F.col("l_discount")))
    days = (
        sales(spark, sf)
        .withColumn("price", price)
        .groupBy("cm_product_id", "variant_key", "value_date")
        .agg(
            F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("price").cast("decimal(28,12)"))), 8).cast("double").alias("listed"),
            F.round(F.min("price"), 8).alias("price_low"),
        )
    )
    pid = F.col("cm_product_id")
    zeroed = (F.dayofmonth("value_date") == 10) & (pid % 5 == 0)
    game = game_of(pid)
    return days.select(
        game.alias("game_key"),
        pid,
        "variant_key",
        "value_date",
        kind_of(pid).alias("product_kind"),
        F.when(zeroed, 0.0).otherwise(F.col("listed")).alias("price_avg"),
        "price_low",
        F.when(pid % 3 != 0, F.col("listed")).alias("avg30"),
        variant_id(game, pid, F.col("variant_key")).alias("stable_variant_id"),
        product_id(game, pid).alias("stable_product_id"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """One catalogue row per brand."""
    pid = F.col("cm_product_id")
    counts = (
        table(spark, sf, "part")
        .select(brand_id(F.col("p_brand")).alias("cm_product_id"), "p_brand", "p_type")
        .groupBy("cm_product_id", "p_brand", "p_type")
        .count()
    )
    top = counts.groupBy("cm_product_id", "p_brand").agg(
        F.min_by("p_type", F.struct(-F.col("count"), F.col("p_type"))).alias("raw_category")
    )
    source = (
        F.when(pid % 6 == 0, "")
        .when(pid % 11 == 0, "0000-00-00")
        .otherwise(F.date_add(F.lit(date(1994, 1, 1)), (pid * 40).cast("int")).cast("string"))
    )
    return top.select(
        product_id(game_of(pid), pid).alias("stable_product_id"),
        game_of(pid).alias("game_key"),
        pid,
        F.when(pid % 7 != 0, pid % 7).alias("cm_expansion_id"),
        F.col("p_brand").alias("name"),
        kind_of(pid).alias("product_kind"),
        "raw_category",
        source.alias("source_date_added"),
        F.lit(date(1995, 1, 2)).alias("first_seen"),
    )


def sets(spark: SparkSession, sf: str) -> DataFrame:
    """Expansions of the catalogue; expansion 5 is not listed."""
    return (
        products(spark, sf)
        .filter(F.col("cm_expansion_id").isNotNull() & (F.col("cm_expansion_id") != 5))
        .select("game_key", "cm_expansion_id")
        .distinct()
        .select(
            set_id(F.col("game_key"), F.col("cm_expansion_id")).alias("stable_set_id"),
            "game_key",
            "cm_expansion_id",
            F.concat(F.lit("Set "), F.col("cm_expansion_id").cast("string")).alias("name"),
        )
    )


def archive_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Order days as observation days of both games; the 15th repeats the day before."""
    games = F.explode(F.array(F.lit("onepiece"), F.lit("pokemon")))
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("value_date")).distinct()
    return days.select(
        games.alias("game_key"), "value_date", (F.dayofmonth("value_date") == 15).alias("unchanged")
    )


def index_of(game: Column, kind: Column) -> Column:
    return (
        F.when((game == "onepiece") & (kind == "single"), "ONS8")
        .when(game == "onepiece", "ONB2")
        .when(kind == "single", "PKS8")
        .otherwise("PKB3")
    )


def basket(spark: SparkSession, sf: str) -> DataFrame:
    """Rebalance members: each month the best sellers of the month before, per index."""
    from pyspark.sql import Window

    pid = F.col("cm_product_id")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sold = (
        sales(spark, sf)
        .withColumn("effective_date", F.add_months(F.trunc("value_date", "MM"), 1))
        .groupBy("effective_date", "cm_product_id", "variant_key")
        .agg(F.round(F.sum(revenue), 4).alias("revenue"), F.round(F.avg("l_extendedprice"), 8).alias("ref_price"))
        .withColumn("index_code", index_of(game_of(pid), kind_of(pid)))
    )
    keys = ["index_code", "effective_date"]
    order = Window.partitionBy(*keys).orderBy(F.desc("revenue"), "cm_product_id", "variant_key")
    limits = definitions(spark).select("index_code", "target_size", "game_key")
    top = (
        sold.withColumn("rank", F.row_number().over(order))
        .join(limits, "index_code")
        .filter(F.col("rank") <= F.col("target_size"))
    )
    seen = Window.partitionBy("index_code", "cm_product_id", "variant_key").orderBy("effective_date")
    kept = F.col("effective_date") == F.add_months(F.lag("effective_date").over(seen), 1)
    action = F.when(F.coalesce(kept, F.lit(False)), "retained").otherwise("added")
    return top.withColumn("action", action).select(
        *keys,
        "cm_product_id",
        "variant_key",
        variant_id(F.col("game_key"), pid, F.col("variant_key")).alias("stable_variant_id"),
        "action",
        F.when(pid % 4 != 0, F.concat(F.lit("rank "), F.col("rank").cast("string"))).alias("reason"),
        (1.0 / F.col("rank")).alias("liquidity_score"),
        "ref_price",
        "rank",
    )


def basket_removed(spark: SparkSession, sf: str) -> DataFrame:
    return (
        selection.left_behind(basket(spark, sf))
        .withColumn("action", F.lit("removed"))
        .withColumn("reason", F.when(F.col("cm_product_id") % 4 != 0, F.lit("left the top list")))
    )


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    defs = definitions(spark)
    panel = chain.member_panel(
        price_panel(spark, sf), basket(spark, sf), archive_calendar(spark, sf), defs, METHOD
    )
    return chain.flag_members(panel, METHOD)


def chain_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(daily values, contributions) of the revenue baskets."""
    rows = flagged(spark, sf)
    values = chain.link(chain.daily_returns(rows), definitions(spark), METHOD)
    return values, chain.contributions(rows)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Named membership intervals of the revenue baskets."""
    rows = membership.lifecycle(basket(spark, sf), basket_removed(spark, sf))
    return membership.with_catalogue_names(
        rows, definitions(spark), products(spark, sf), sets(spark, sf)
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order revenue per priority as an index history."""
    from pyspark.sql import Window

    days = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("index_code"), F.to_date("o_orderdate").alias("value_date"))
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("index_value"),
            F.count(F.lit(1)).cast("int").alias("n_constituents_active"),
            F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)).cast("int").alias("capped"),
            F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).cast("int").alias("carried"),
        )
    )
    path = Window.partitionBy("index_code").orderBy("value_date")
    before = F.lag("index_value").over(path)
    return days.select(
        "index_code",
        "value_date",
        "index_value",
        F.coalesce(F.col("index_value") / before - 1, F.lit(0.0)).alias("daily_return"),
        "n_constituents_active",
        F.when(F.dayofmonth("value_date") != 3, F.col("capped")).alias("n_capped"),
        F.when(F.dayofmonth("value_date") != 4, F.col("carried")).alias("n_carried_forward"),
        F.when(F.dayofmonth("value_date") != 5, F.lit("1.3.0")).alias("calc_version"),
    )


def history_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of the order histories, one row per priority, plus one without any rows."""
    code = F.col("index_code")
    found = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("index_code")).distinct()
    extra = literal_table(spark, [("9-EMPTY",)], struct("index_code string"))
    return found.unionByName(extra).select(
        code,
        F.concat(F.lit("Index "), code).alias("name"),
        F.when(code.isin("5-LOW", "9-EMPTY"), "accumulating").otherwise("published").alias("status"),
        F.when(code == "3-MEDIUM", "validation").otherwise("published").alias("history_start_kind"),
        F.when(code < "3", "singles").otherwise("sealed").alias("universe"),
        F.lit(date(1995, 1, 1)).alias("history_start_date"),
        F.lit(date(1995, 1, 10)).alias("base_date"),
        F.length(code).cast("int").alias("target_size"),
    )


def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Archive manifest entries: one per order day, game and kind."""
    rows = (
        table(spark, sf, "orders")
        .groupBy(
            F.to_date("o_orderdate").alias("run_date"),
            F.when(F.col("o_custkey") % 2 == 0, "onepiece").otherwise("pokemon").alias("game_key"),
            F.when(F.col("o_orderkey") % 2 == 0, "priceguide").otherwise("catalogue").alias("kind"),
        )
        .agg(F.count(F.lit(1)).alias("records"), F.sum("o_orderkey").alias("key_sum"))
    )
    k = F.col("key_sum")
    good_key = snapshot_key(F.col("kind"), F.col("game_key"), F.col("run_date"))
    return rows.select(
        "run_date",
        "game_key",
        "kind",
        F.when(k % 31 == 0, F.concat(F.lit("misplaced/"), good_key)).otherwise(good_key).alias("key"),
        F.when(k % 41 == 0, "bad").otherwise(content_sha((k % 3).cast("string"))).alias("sha256"),
        F.when(k % 37 == 0, 0).otherwise(F.col("records") * 100).cast("bigint").alias("size"),
        F.when(k % 29 == 0, "yesterday")
        .otherwise(F.concat(F.col("run_date").cast("string"), F.lit("T06:00:00+00:00")))
        .alias("fetched_at"),
        F.when(k % 43 == 0, 2).otherwise(1).alias("schema_version"),
        "records",
        k.alias("key_sum"),
    )


def part_game(pid: Column) -> Column:
    return F.when(pid % 2 == 0, "onepiece").otherwise("pokemon")


def _enveloped(key: Column, records: Column) -> Column:
    """A JSON document around an array of record texts; the shape depends on the key."""
    # The records stand in one place: a copy of their expression for each shape makes the
    # generated method too long for the JVM to compile.
    meta = '{"version": 1, "createdAt": "2001-01-01T00:00:00+0000", "%s": '
    head = F.when(key % 6 == 0, "")
    for i, member in enumerate(["data", "products", "priceGuide", "priceGuides", "items"], start=1):
        head = head.when(key % 6 == i, meta % member)
    return F.concat(
        head,
        F.lit("["),
        F.when(key % 2 == 0, '"stray", ').otherwise(""),
        F.array_join(records, ", "),
        F.lit("]"),
        F.when(key % 6 == 0, "").otherwise("}"),
    )


def price_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Price-guide documents, one per line item, with two records each."""
    line = spread(table(spark, sf, "lineitem"), "l_orderkey")
    pid = F.col("l_partkey")
    holo, untaxed = part_game(pid) == "pokemon", F.col("l_tax") == 0
    foil = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 2)
    first = F.to_json(
        F.struct(
            pid.alias("idProduct"),
            F.col("l_linenumber").alias("idCategory"),
            F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).alias("avg"),
            F.when(F.col("l_discount") > 0.03, F.col("l_quantity")).alias("low"),
            F.col("l_extendedprice").alias("avg7"),
            F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("avg30"),
            F.when(holo, F.lit(999999.0)).when(~untaxed, foil).alias("avg-foil"),
            F.when(holo & ~untaxed, foil).alias("avg-holo"),
            F.when(untaxed, foil).alias("foilAvg"),
        )
    )
    second = F.to_json(
        F.struct(
            (pid + 1000000).cast("string").alias("id"), F.col("l_quantity").alias("price_avg")
        )
    )
    return line.select(
        F.col("l_orderkey").alias("doc_key"),
        part_game(pid).alias("game_key"),
        F.to_date("l_shipdate").alias("run_date"),
        F.lit("priceguide").alias("kind"),
        _enveloped(F.col("l_orderkey"), F.array(first, second)).alias("body"),
    )


def catalogue_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue documents, one per part (every tenth part is not listed)."""
    part = spread(table(spark, sf, "part"), "p_partkey").filter(F.col("p_partkey") % 10 != 3)
    pid = F.col("p_partkey")
    record = F.to_json(
        F.struct(
            pid.alias("idProduct"),
            F.when(pid % 13 != 0, F.col("p_name")).alias("name"),
            F.when(pid % 17 != 0, F.concat(F.lit(" "), F.col("p_type"))).alias("categoryName"),
            F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 7).alias("idExpansion"),
            F.when(pid % 3 == 0, F.concat(F.lit("Set of "), F.col("p_name"))).alias("setName"),
            F.when(pid % 5 == 0, "0000-00-00 00:00:00")
            .when(pid % 5 == 1, " ")
            .otherwise("1994-05-05")
            .alias("dateAdded"),
        )
    )
    return part.select(
        pid.alias("doc_key"),
        part_game(pid).alias("game_key"),
        F.date_add(F.lit(date(2001, 1, 1)), (F.col("p_size") % 3).cast("int")).alias("run_date"),
        F.lit("catalogue").alias("kind"),
        F.concat(F.lit('{"version": 1, "products": ['), record, F.lit("]}")).alias("body"),
    )


def holdings_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings CSV files, one per line item: its holding, the same one again, and a bad line."""
    line = spread(table(spark, sf, "lineitem"), "l_orderkey")
    part = table(spark, sf, "part").select("p_partkey", brand_id(F.col("p_brand")).alias("pid"))
    rows = line.join(part, line.l_partkey == part.p_partkey)
    cost = F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice").cast("string")).otherwise("")
    own = F.concat_ws(
        ",",
        F.col("pid").cast("string"),
        F.when(F.col("l_returnflag") == "R", " foil ").otherwise(""),
        F.when(F.col("l_tax") == 0, "-1").otherwise(F.col("l_quantity").cast("string")),
        cost,
    )
    other = F.concat_ws(
        ",", F.col("l_suppkey").cast("string"), F.lit("foil"), F.lit("2.5"), F.lit("")
    )
    header = F.when(F.col("l_linenumber") == 7, "cm_product_id,variant_key,cost_basis_eur").otherwise(
        "cm_product_id,variant_key,quantity,cost_basis_eur"
    )
    return rows.select(
        F.concat_ws(
            "/",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.to_date("l_shipdate"),
        ).alias("portfolio_id"),
        F.concat_ws("\n", header, own, F.lit(""), own, F.lit("x,foil,1,"), other).alias("csv"),
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Valid holdings rows: every order is a portfolio, its lines by position of value."""
    part = table(spark, sf, "part").select("p_partkey", brand_id(F.col("p_brand")).alias("cm_product_id"))
    line = table(spark, sf, "lineitem")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("l_orderkey").alias("portfolio_id"),
            F.col("l_linenumber").alias("line"),
            F.when(F.col("l_tax") == 0, F.lit("Invalid quantity")).alias("error"),
            "cm_product_id",
            variant_of(F.col("l_returnflag")).alias("variant_key"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice") / F.col("l_quantity")).alias("cost_basis_eur"),
        )
        # Line numbers repeat in the test data: a holdings line is the first of its number.
        .groupBy("portfolio_id", "line")
        .agg(F.min(F.struct("cm_product_id", "variant_key", "quantity", "cost_basis_eur", "error")).alias("h"))
        .select("portfolio_id", "line", "h.error", "h.cm_product_id", "h.variant_key", "h.quantity", "h.cost_basis_eur")
    )


# --- SQL twins ------------------------------------------------------------------------

GAME = "CASE WHEN {0} % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END"
KIND = "CASE WHEN {0} <= 20 THEN 'single' ELSE 'sealed' END"
BRAND = r"CAST(regexp_extract(p_brand, '#(\d+)', 1) AS BIGINT)"

SQL: dict[str, tuple[list[str], str]] = {
    "definitions": (
        [],
        """SELECT * FROM (VALUES
        ('ONS8', 'One Singles 8', 'onepiece', 'singles', 'single', 8, DATE '1995-03-01', 1000.0::DOUBLE, 'published', 5.0, 10, 7, 'resolved_all_cardmarket_europe_languages'),
        ('ONB2', 'One Sealed 2', 'onepiece', 'sealed', 'sealed', 2, DATE '1995-03-01', 1000.0::DOUBLE, 'accumulating', 10.0, 3, 1, 'resolved_all_cardmarket_europe_languages'),
        ('PKS8', 'Poke Singles 8', 'pokemon', 'singles', 'single', 8, DATE '1995-06-01', 500.0::DOUBLE, 'published', 5.0, 10, 7, 'pending_source_field'),
        ('PKB3', 'Poke Sealed 3', 'pokemon', 'sealed', 'sealed', 3, DATE '1995-03-01', 1000.0::DOUBLE, 'draft', 10.0, 4, 2, 'resolved_all_cardmarket_europe_languages')
        ) d(index_code, name, game_key, universe, product_kind, target_size, base_date, base_value, status, min_price, retention_cutoff, entry_cutoff, language_scope_status)""",
    ),
    "sales": (
        [],
        f"""SELECT {BRAND} AS cm_product_id, p_retailprice, l_quantity, l_extendedprice, l_discount, l_linestatus,
        CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS variant_key, CAST(l_shipdate AS DATE) AS value_date
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    ),
    "price_days": (
        ["sales"],
        """SELECT cm_product_id, variant_key, value_date, ROUND(AVG(price) FILTER (l_linestatus = 'O'), 8) AS listed, ROUND(MIN(price), 8) AS price_low
        FROM (SELECT *, CASE WHEN variant_key = 'foil' THEN l_extendedprice / l_quantity ELSE p_retailprice * (1 - l_discount) END AS price FROM sales)
        GROUP BY 1, 2, 3""",
    ),
    "price_panel": (
        ["price_days"],
        f"""SELECT {GAME.format('cm_product_id')} AS game_key, cm_product_id, variant_key, value_date, {KIND.format('cm_product_id')} AS product_kind,
        CASE WHEN day(value_date) = 10 AND cm_product_id % 5 = 0 THEN 0.0 ELSE listed END AS price_avg, price_low,
        CASE WHEN cm_product_id % 3 <> 0 THEN listed END AS avg30,
        'cardmarket:' || {GAME.format('cm_product_id')} || ':product:' || cm_product_id || ':' || variant_key AS stable_variant_id,
        'cardmarket:' || {GAME.format('cm_product_id')} || ':product:' || cm_product_id AS stable_product_id
        FROM price_days""",
    ),
    "products": (
        [],
        f"""SELECT {GAME.format('cm_product_id')} AS game_key, cm_product_id,
        CASE WHEN cm_product_id % 7 <> 0 THEN cm_product_id % 7 END AS cm_expansion_id, p_brand AS name,
        {KIND.format('cm_product_id')} AS product_kind, raw_category,
        CASE WHEN cm_product_id % 6 = 0 THEN '' WHEN cm_product_id % 11 = 0 THEN '0000-00-00'
             ELSE CAST(DATE '1994-01-01' + CAST(cm_product_id * 40 AS INT) AS VARCHAR) END AS source_date_added,
        CASE WHEN cm_product_id % 6 = 0 THEN DATE '1995-01-02' WHEN cm_product_id % 11 = 0 THEN NULL
             ELSE DATE '1994-01-01' + CAST(cm_product_id * 40 AS INT) END AS added_on
        FROM (SELECT cm_product_id, p_brand, p_type AS raw_category,
                     row_number() OVER (PARTITION BY cm_product_id, p_brand ORDER BY n DESC, p_type) AS rn
              FROM (SELECT {BRAND} AS cm_product_id, p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3)) WHERE rn = 1""",
    ),
    "sets": (
        ["products"],
        """SELECT DISTINCT game_key, cm_expansion_id, 'Set ' || cm_expansion_id AS name FROM products
        WHERE cm_expansion_id IS NOT NULL AND cm_expansion_id <> 5""",
    ),
    "archive_calendar": (
        [],
        """SELECT g AS game_key, value_date, day(value_date) = 15 AS unchanged
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS value_date FROM orders), (VALUES ('onepiece'), ('pokemon')) t(g)""",
    ),
    "basket": (
        ["sales", "definitions"],
        f"""SELECT index_code, effective_date, cm_product_id, variant_key,
        'cardmarket:' || game_key || ':product:' || cm_product_id || ':' || variant_key AS stable_variant_id,
        CASE WHEN lag(effective_date) OVER (PARTITION BY index_code, cm_product_id, variant_key ORDER BY effective_date) + INTERVAL 1 MONTH = effective_date
             THEN 'retained' ELSE 'added' END AS action,
        CASE WHEN cm_product_id % 4 <> 0 THEN 'rank ' || rank END AS reason, 1.0::DOUBLE / rank AS liquidity_score, ref_price, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY index_code, effective_date ORDER BY revenue DESC, cm_product_id, variant_key) AS rank
              FROM (SELECT CAST(date_trunc('month', value_date) + INTERVAL 1 MONTH AS DATE) AS effective_date, cm_product_id, variant_key,
                           ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, ROUND(AVG(l_extendedprice), 8) AS ref_price
                    FROM sales GROUP BY 1, 2, 3) s
              JOIN definitions d ON d.game_key = {GAME.format('s.cm_product_id')} AND d.product_kind = {KIND.format('s.cm_product_id')})
        WHERE rank <= target_size""",
    ),
    "basket_steps": (
        ["basket"],
        """SELECT *, lead(effective_date) OVER (PARTITION BY index_code ORDER BY effective_date) AS next_date,
        row_number() OVER (PARTITION BY index_code ORDER BY effective_date) AS step
        FROM (SELECT DISTINCT index_code, effective_date FROM basket)""",
    ),
    "basket_removed": (
        ["basket", "basket_steps"],
        """SELECT b.index_code, s.next_date AS effective_date, b.cm_product_id, b.variant_key, 'removed' AS action,
        CASE WHEN b.cm_product_id % 4 <> 0 THEN 'left the top list' END AS reason
        FROM basket b JOIN basket_steps s USING (index_code, effective_date)
        WHERE s.next_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM basket c WHERE c.index_code = b.index_code AND c.effective_date = s.next_date
          AND c.cm_product_id = b.cm_product_id AND c.variant_key = b.variant_key)""",
    ),
    "panel": (
        ["basket", "basket_steps", "archive_calendar", "definitions", "price_panel"],
        """SELECT s.index_code, c.value_date, s.effective_date, c.unchanged, b.cm_product_id, b.variant_key, b.stable_variant_id,
        coalesce(p.price_avg, p.price_low) AS used_price
        FROM archive_calendar c JOIN definitions d USING (game_key)
        JOIN basket_steps s ON s.index_code = d.index_code AND c.value_date >= s.effective_date AND (s.next_date IS NULL OR c.value_date < s.next_date)
        JOIN basket b ON b.index_code = s.index_code AND b.effective_date = s.effective_date
        LEFT JOIN price_panel p ON p.game_key = d.game_key AND p.cm_product_id = b.cm_product_id AND p.variant_key = b.variant_key AND p.value_date = c.value_date""",
    ),
}


def _chain_views(panel: str, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    """Flags, contributions and values over a panel view."""
    p = prefix
    return {
        f"{p}state": (
            [panel],
            f"""SELECT *, count(obs) OVER w AS grp,
            last_value(obs IGNORE NULLS) OVER (PARTITION BY index_code, cm_product_id, variant_key ORDER BY value_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
            FROM (SELECT *, CASE WHEN used_price > 0 AND NOT unchanged THEN used_price END AS obs FROM {panel})
            WINDOW w AS (PARTITION BY index_code, cm_product_id, variant_key ORDER BY value_date)""",
        ),
        f"{p}flagged": (
            [f"{p}state"],
            f"""SELECT index_code, value_date, effective_date, unchanged, stable_variant_id, cm_product_id, variant_key, flag,
            CASE WHEN flag IN ('fresh', 'spike_capped') THEN used ELSE 0 END AS used_return
            FROM (SELECT *, CASE WHEN unchanged THEN CASE WHEN prev IS NOT NULL THEN 'snapshot_unchanged' END
                WHEN obs IS NOT NULL AND prev IS NULL THEN 'initialized'
                WHEN obs IS NOT NULL THEN CASE WHEN abs(used - raw) > 1e-15 THEN 'spike_capped' ELSE 'fresh' END
                WHEN prev IS NOT NULL AND k <= 5 THEN 'carried_forward' ELSE 'stale' END AS flag
              FROM (SELECT *, obs / prev - 1 AS raw, CASE WHEN obs / prev IS NOT NULL THEN greatest(-0.25, least(0.25, obs / prev - 1)) END AS used,
                    sum(CASE WHEN obs IS NULL AND NOT unchanged THEN 1 ELSE 0 END) OVER (PARTITION BY index_code, cm_product_id, variant_key, grp ORDER BY value_date) AS k
                    FROM {p}state))
            WHERE flag IS NOT NULL""",
        ),
        f"{p}contributions": (
            [f"{p}flagged"],
            f"""SELECT *, weight * used_return AS contribution FROM (
            SELECT index_code, value_date, stable_variant_id, cm_product_id, variant_key, used_return, flag,
            1.0::DOUBLE / count(*) OVER (PARTITION BY index_code, value_date) AS weight
            FROM {p}flagged WHERE flag <> 'stale')""",
        ),
        f"{p}daily_values": (
            [f"{p}flagged", "definitions"],
            f"""SELECT index_code, value_date, d.base_value * product(1 + daily_return) OVER (PARTITION BY index_code ORDER BY value_date) AS index_value,
            daily_return, n_constituents_active, n_capped, n_carried_forward, n_stale, whole_market_carried_forward, rebalance_effective_date, '1.3.0' AS calc_version
            FROM (SELECT index_code, value_date, avg(used_return) FILTER (flag <> 'stale') AS daily_return,
                count(*) FILTER (flag <> 'stale') AS n_constituents_active, count(*) FILTER (flag = 'spike_capped') AS n_capped,
                count(*) FILTER (flag IN ('carried_forward', 'snapshot_unchanged')) AS n_carried_forward, count(*) FILTER (flag = 'stale') AS n_stale,
                bool_or(unchanged) AS whole_market_carried_forward, max(effective_date) AS rebalance_effective_date
                FROM {p}flagged GROUP BY 1, 2) r JOIN definitions d USING (index_code) WHERE n_constituents_active > 0""",
        ),
    }


SQL.update(_chain_views("panel"))
SQL.update(
    {
        "islands": (
            ["basket", "basket_steps"],
            """SELECT b.*, s.step, s.step - row_number() OVER (PARTITION BY index_code, cm_product_id, variant_key ORDER BY effective_date) AS island
            FROM basket b JOIN basket_steps s USING (index_code, effective_date)""",
        ),
        "bare_intervals": (
            ["islands", "basket_steps"],
            """SELECT i.*, s.effective_date AS removed_at FROM (
              SELECT index_code, cm_product_id, variant_key, island, min(effective_date) AS member_since, max(step) AS last_step,
                arg_min(action, effective_date) AS entry_action, min(struct_pack(d := effective_date, r := reason)).r AS entry_reason,
                arg_min(liquidity_score, effective_date) AS liquidity_score, arg_min(ref_price, effective_date) AS ref_price
              FROM islands GROUP BY 1, 2, 3, 4) i
            LEFT JOIN basket_steps s ON s.index_code = i.index_code AND s.step = i.last_step + 1""",
        ),
        "intervals": (
            ["bare_intervals", "definitions", "products", "sets"],
            """SELECT i.index_code, i.cm_product_id, i.variant_key, coalesce(p.name, 'Product ' || i.cm_product_id) AS name,
            CASE WHEN p.cm_expansion_id IS NULL THEN 'Unknown set' ELSE coalesce(s.name, 'Expansion ' || p.cm_expansion_id) END AS set_name,
            member_since, removed_at, CASE WHEN removed_at IS NOT NULL THEN 'removed' ELSE entry_action END AS action, entry_reason,
            CASE WHEN removed_at IS NOT NULL AND i.cm_product_id % 4 <> 0 THEN 'left the top list' END AS removal_reason, liquidity_score, ref_price
            FROM bare_intervals i JOIN definitions d USING (index_code)
            LEFT JOIN products p ON p.game_key = d.game_key AND p.cm_product_id = i.cm_product_id
            LEFT JOIN sets s ON s.game_key = d.game_key AND s.cm_expansion_id = p.cm_expansion_id""",
        ),
        "history_days": (
            [],
            """SELECT o_orderpriority AS index_code, CAST(o_orderdate AS DATE) AS value_date, ROUND(SUM(o_totalprice), 2) AS index_value,
            count(*) AS n_constituents_active, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 300000) AS capped,
            count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) AS carried FROM orders GROUP BY 1, 2""",
        ),
        "history": (
            ["history_days"],
            """SELECT index_code, value_date, index_value,
            coalesce(index_value / lag(index_value) OVER (PARTITION BY index_code ORDER BY value_date) - 1, 0) AS daily_return, n_constituents_active,
            CASE WHEN day(value_date) <> 3 THEN capped END AS n_capped, CASE WHEN day(value_date) <> 4 THEN carried END AS n_carried_forward,
            CASE WHEN day(value_date) <> 5 THEN '1.3.0' END AS calc_version FROM history_days""",
        ),
        "history_definitions": (
            [],
            """SELECT index_code, 'Index ' || index_code AS name, CASE WHEN index_code IN ('5-LOW', '9-EMPTY') THEN 'accumulating' ELSE 'published' END AS status,
            CASE WHEN index_code = '3-MEDIUM' THEN 'validation' ELSE 'published' END AS history_start_kind,
            CASE WHEN index_code < '3' THEN 'singles' ELSE 'sealed' END AS universe, DATE '1995-01-01' AS history_start_date, DATE '1995-01-10' AS base_date,
            length(index_code) AS target_size
            FROM (SELECT DISTINCT o_orderpriority AS index_code FROM orders UNION ALL SELECT '9-EMPTY')""",
        ),
        "manifest_rows": (
            [],
            """SELECT CAST(o_orderdate AS DATE) AS run_date, CASE WHEN o_custkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key,
            CASE WHEN o_orderkey % 2 = 0 THEN 'priceguide' ELSE 'catalogue' END AS kind, count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS k
            FROM orders GROUP BY 1, 2, 3""",
        ),
        "manifest_files": (
            ["manifest_rows"],
            """SELECT run_date, game_key, kind, CASE WHEN k % 31 = 0 THEN 'misplaced/' ELSE '' END || good_key AS key, good_key,
            CASE WHEN k % 41 = 0 THEN 'bad' ELSE sha256(CAST(k % 3 AS VARCHAR)) END AS sha256,
            CASE WHEN k % 37 = 0 THEN 0 ELSE records * 100 END AS size,
            CASE WHEN k % 29 = 0 THEN 'yesterday' ELSE run_date || 'T06:00:00+00:00' END AS fetched_at,
            CASE WHEN k % 43 = 0 THEN 2 ELSE 1 END AS schema_version, records, k AS key_sum
            FROM (SELECT *, 'cardmarket/' || kind || '/' || game_key || '/' || strftime(run_date, '%Y/%m') || '/' || run_date || '.json.gz' AS good_key FROM manifest_rows)""",
        ),
        "price_records": (
            [],
            """SELECT l_orderkey AS doc_key, CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, CAST(l_shipdate AS DATE) AS run_date,
            l_partkey AS cm_product_id, CAST(l_linenumber AS BIGINT) AS cm_category_id, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS source_pos,
            CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS base_avg, CASE WHEN l_discount > 0.03 THEN l_quantity END AS base_low,
            l_extendedprice AS base_avg7, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS base_avg30,
            CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 END AS second_avg
            FROM lineitem WHERE l_orderkey % 6 <> 5
            UNION ALL
            SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END, CAST(l_shipdate AS DATE), l_partkey + 1000000, NULL,
            CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END, l_quantity, NULL, NULL, NULL, NULL
            FROM lineitem WHERE l_orderkey % 6 <> 5""",
        ),
        "price_rows": (
            ["price_records"],
            """SELECT doc_key, game_key, run_date, cm_product_id, cm_category_id, 'nonfoil' AS variant_key, base_low AS price_low, base_avg AS price_avg, base_avg7 AS avg7, base_avg30 AS avg30
            FROM price_records WHERE base_avg IS NOT NULL OR base_low IS NOT NULL
            UNION ALL SELECT doc_key, game_key, run_date, cm_product_id, cm_category_id, 'foil', NULL, second_avg, NULL, NULL FROM price_records WHERE second_avg IS NOT NULL""",
        ),
        "listings": (
            [],
            """SELECT CASE WHEN l_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS run_date, l_partkey AS pid, max(l_extendedprice) AS price,
            row_number() OVER (PARTITION BY l_partkey % 2, date_trunc('month', CAST(l_shipdate AS DATE)) ORDER BY l_partkey) - 1 AS source_pos
            FROM lineitem GROUP BY l_partkey, date_trunc('month', CAST(l_shipdate AS DATE))""",
        ),
        "listing_files": (
            ["listings"],
            """SELECT game_key, run_date, kind, count(*) AS records, 'cardmarket/' || kind || '/' || game_key || '/' || strftime(run_date, '%Y/%m') || '/' || run_date || '.json.gz' AS key
            FROM listings, (VALUES ('priceguide'), ('catalogue')) k(kind) GROUP BY ALL""",
        ),
        "category_map": (
            [],
            "SELECT * FROM (VALUES ('standard', 'single'), ('medium', 'single'), ('small', 'single'), ('promo', 'sealed'), ('large', 'sealed'), ('misc', 'other')) c(label, kind)",
        ),
        "catalogue_records": (
            ["category_map"],
            """SELECT p_partkey AS cm_product_id, CASE WHEN p_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS game_key,
            DATE '2001-01-01' + (p_size % 3) AS run_date, CASE WHEN p_partkey % 13 <> 0 THEN p_name ELSE 'Product ' || p_partkey END AS name,
            CASE WHEN p_partkey % 17 <> 0 THEN p_type ELSE '' END AS raw_category,
            CASE WHEN p_size % 7 <> 0 THEN p_size % 7 END AS cm_expansion_id, CASE WHEN p_partkey % 3 = 0 THEN 'Set of ' || p_name END AS expansion_name,
            CASE WHEN p_partkey % 5 > 1 THEN '1994-05-05' END AS source_date_added, coalesce(c.kind, 'other') AS product_kind, c.kind IS NOT NULL AS category_known
            FROM part LEFT JOIN category_map c ON p_partkey % 17 <> 0 AND c.label = lower(p_type) WHERE p_partkey % 10 <> 3""",
        ),
        "holdings": (
            [],
            f"""SELECT portfolio_id, line, h.cm_product_id, h.variant_key, h.quantity, h.cost_basis_eur, h.error FROM (
            SELECT l_orderkey AS portfolio_id, l_linenumber AS line,
            arg_min(struct_pack(cm_product_id := pid, variant_key := v, quantity := l_quantity, cost_basis_eur := cost, error := err),
                    struct_pack(a := pid, b := v, c := l_quantity, d := coalesce(cost, -1), e := coalesce(err, ''))) AS h
            FROM (SELECT *, {BRAND} AS pid, CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS v,
                  CASE WHEN l_discount > 0.02 THEN l_extendedprice / l_quantity END AS cost, CASE WHEN l_tax = 0 THEN 'Invalid quantity' END AS err
                  FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2)""",
        ),
    }
)


def sql(views: str | list[str], body: str) -> str:
    """`body` preceded by the WITH clause of the named views and their inputs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in SQL[name][0]:
            visit(dep)
        ordered.append(name)

    for name in [views] if isinstance(views, str) else views:
        visit(name)
    if not ordered:
        return body
    # Materialised once each: several views are read more than once.
    ctes = ",\n".join(
        f"{n} AS {'' if n == 'fold' else 'MATERIALIZED '}({SQL[n][1]})" for n in ordered
    )
    recursive = "RECURSIVE " if "fold" in ordered else ""
    return f"WITH {recursive}{ctes}\n{body}"
