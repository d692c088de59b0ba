"""Scalar expression queries over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import dates, hashing, ids, prices, text
from pricetide.queries import views
from pricetide.queries.registry import query


@query(
    "stable_ids",
    "F1",
    "p_partkey:i product:s variant:s expansion:s",
    """SELECT p_partkey, 'cardmarket:' || g || ':product:' || p_partkey AS product,
    'cardmarket:' || g || ':product:' || p_partkey || ':foil' AS variant, 'cardmarket:' || g || ':expansion:' || p_size AS expansion
    FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'onepiece' ELSE 'pokemon' END AS g FROM part)""",
)
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.col("p_partkey")
    game = views.part_game(pid)
    return views.table(spark, sf, "part").select(
        pid,
        ids.product_id(game, pid).alias("product"),
        ids.variant_id(game, pid, F.lit("foil")).alias("variant"),
        ids.set_id(game, F.col("p_size")).alias("expansion"),
    )


@query(
    "category_classification",
    "F2 S6",
    "p_partkey:i label:s kind:s known:b",
    """SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS label, coalesce(c.kind, 'other') AS kind, c.kind IS NOT NULL AS known
    FROM part LEFT JOIN category_map c ON c.label = lower(p_type)""",
    ["category_map"],
)
def category_classification(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.operators.normalize import classify

    raw = F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))
    rows = views.table(spark, sf, "part").select("p_partkey", raw.alias("raw_category"))
    return classify(rows, views.categories(spark)).select(
        "p_partkey",
        text.label_key(F.col("raw_category")).alias("label"),
        F.col("product_kind").alias("kind"),
        F.col("category_known").alias("known"),
    )


@query(
    "category_conflicts",
    "S6 A12",
    "label:s kinds:i",
    """SELECT lower(p_type) AS label, count(DISTINCT p_size % 3) AS kinds FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 3) > 1""",
)
def category_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.sources.categories import conflicting_labels

    rows = views.table(spark, sf, "part").select(
        text.label_key(F.col("p_type")).alias("label"), (F.col("p_size") % 3).cast("string").alias("kind")
    )
    return conflicting_labels(rows)


@query(
    "source_dates",
    "F3",
    "o_orderkey:i cleaned:s parsed:s",
    """SELECT o_orderkey, CASE WHEN o_custkey % 4 IN (0, 1) THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 10:00:00' END AS cleaned,
    CASE WHEN o_custkey % 4 IN (0, 1) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
)
def source_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    raw = (
        F.when(k == 0, "   ")
        .when(k == 1, "0000-00-00 00:00:00")
        .otherwise(F.concat(F.lit(" "), F.to_date("o_orderdate").cast("string"), F.lit(" 10:00:00 ")))
    )
    cleaned = text.source_date(raw)
    return views.table(spark, sf, "orders").select(
        "o_orderkey", cleaned.alias("cleaned"), dates.lenient_date(cleaned).alias("parsed")
    )


@query(
    "archive_keys",
    "F5",
    "run_date:s snapshot:s manifest:s",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS run_date,
    'cardmarket/priceguide/magic/' || strftime(o_orderdate, '%Y/%m/%Y-%m-%d') || '.json.gz' AS snapshot,
    'manifests/' || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS manifest FROM orders""",
)
def archive_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("run_date")
    days = views.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("run_date")).distinct()
    return days.select(
        d,
        ids.snapshot_key(F.lit("priceguide"), F.lit("magic"), d).alias("snapshot"),
        ids.manifest_key(d).alias("manifest"),
    )


@query(
    "text_patterns",
    "F6",
    "o_orderkey:i gap_day:s week_ok:b token_ok:b date_ok:b",
    r"""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS gap_day,
    regexp_full_match(strftime(o_orderdate, '%Y') || CASE WHEN o_custkey % 3 = 0 THEN '-W9' ELSE '-W09' END, '\d{4}-W\d{2}') AS week_ok,
    regexp_full_match(left(sha256(CAST(o_orderkey AS VARCHAR)), 32 - CAST(o_custkey % 2 AS INT)), '[a-f0-9]{32}') AS token_ok,
    o_custkey % 5 <> 0 AS date_ok FROM orders""",
)
def text_patterns(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate").cast("string")
    cust = F.col("o_custkey")
    error = F.when(cust % 2 == 0, F.concat(day, F.lit(": missing manifest"))).otherwise(
        F.concat(day, F.lit(": invalid manifest"))
    )
    week = F.concat(F.year("o_orderdate").cast("string"), F.when(cust % 3 == 0, "-W9").otherwise("-W09"))
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    token = F.when(cust % 2 == 0, F.substring(digest, 1, 32)).otherwise(F.substring(digest, 1, 31))
    iso = F.when(cust % 5 == 0, F.concat(day, F.lit("T00:00"))).otherwise(day)
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        text.missing_manifest_day(error).alias("gap_day"),
        text.is_iso_week(week).alias("week_ok"),
        text.is_portfolio_token(token).alias("token_ok"),
        text.is_iso_date(iso).alias("date_ok"),
    )


@query(
    "month_arithmetic",
    "F7 F9 A29",
    "day:s month_start:s next_month:s on_or_after:s before_60:s",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
    CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) AS next_month,
    CASE WHEN day(l_shipdate) = 1 THEN CAST(l_shipdate AS DATE) ELSE CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) END AS on_or_after,
    CAST(l_shipdate AS DATE) - 60 AS before_60 FROM lineitem""",
)
def month_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("day")
    days = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select(
        d,
        dates.month_start(d).alias("month_start"),
        dates.next_month(d).alias("next_month"),
        dates.month_start_on_or_after(d).alias("on_or_after"),
        F.date_sub(d, 60).alias("before_60"),
    )


@query(
    "lookback_months",
    "F7 P3",
    "day:s effective_date:s",
    """SELECT day, CAST(unnest(generate_series(date_trunc('month', day) + INTERVAL 1 MONTH, date_trunc('month', day + 60), INTERVAL 1 MONTH)) AS DATE) AS effective_date
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)""",
)
def lookback_months(spark: SparkSession, sf: str) -> DataFrame:
    days = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select("day", F.explode(dates.month_starts_seen_from(F.col("day"), 60)).alias("effective_date"))


@query(
    "iso_weeks",
    "F8",
    "day:s week:s week_start:s week_end:s bad_week_start:s",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, strftime(l_shipdate, '%G-W%V') AS week, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start,
    CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week_end, NULL AS bad_week_start FROM lineitem""",
)
def iso_weeks(spark: SparkSession, sf: str) -> DataFrame:
    days = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    week = dates.iso_week(F.col("day"))
    return days.select(
        "day",
        week.alias("week"),
        dates.iso_week_start(week).alias("week_start"),
        dates.iso_week_end(week).alias("week_end"),
        dates.iso_week_start(F.concat(F.year("day").cast("string"), F.lit("-W54"))).alias("bad_week_start"),
    )


@query(
    "freshness",
    "F10",
    "c_custkey:i level:s age_days:i label:s",
    """SELECT c_custkey, CASE WHEN bad OR age < 0 THEN 'unknown' WHEN age <= 2 THEN 'fresh' WHEN age <= 7 THEN 'delayed' ELSE 'stale' END AS level,
    CASE WHEN NOT bad AND age >= 0 THEN age END AS age_days,
    CASE WHEN bad THEN 'Freshness unknown' WHEN age < 0 THEN 'Future-dated snapshot' WHEN age = 0 THEN 'Current today'
         WHEN age = 1 THEN '1 day old' ELSE age || ' days old' END AS label
    FROM (SELECT c_custkey, c_custkey % 10 = 9 AS bad, c_custkey % 13 - 2 AS age FROM customer)""",
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    today = F.lit(date(2026, 8, 9))
    age = (F.col("c_custkey") % 13 - 2).cast("int")
    latest = F.when(F.col("c_custkey") % 10 == 9, "not a date").otherwise(
        F.date_sub(today, age).cast("string")
    )
    return views.table(spark, sf, "customer").select(
        "c_custkey",
        dates.freshness_level(latest, today).alias("level"),
        dates.freshness_age(latest, today).alias("age_days"),
        dates.freshness_label(latest, today).alias("label"),
    )


@query(
    "dispersion_and_caps",
    "F11 F12 F13",
    "l_orderkey:i l_linenumber:i dispersion:f8 used:f8 spike:b share:f8",
    """SELECT l_orderkey, l_linenumber, CASE WHEN avgp > 0 THEN coalesce(1 - least(1, greatest(0, abs(l_quantity * 1000 - avgp) / avgp)), 0) ELSE 0 END AS dispersion,
    CASE WHEN avgp IS NOT NULL THEN greatest(-0.25, least(0.25, avgp / 50000 - 1)) END AS used, abs(greatest(-0.25, least(0.25, avgp / 50000 - 1)) - (avgp / 50000 - 1)) > 1e-15 AND avgp IS NOT NULL AS spike,
    CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END AS share
    FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_extendedprice WHEN l_linenumber = 1 THEN 0 END AS avgp FROM lineitem)""",
)
def dispersion_and_caps(spark: SparkSession, sf: str) -> DataFrame:
    avg = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).when(
        F.col("l_linenumber") == 1, 0.0
    )
    raw = avg / 50000 - 1
    used = prices.capped_return(raw, 0.25)
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        prices.inverse_dispersion(F.col("l_quantity") * 1000, avg).alias("dispersion"),
        used.alias("used"),
        F.coalesce(prices.is_spike(raw, used), F.lit(False)).alias("spike"),
        prices.ratio(F.col("l_discount"), F.col("l_tax")).alias("share"),
    )


@query(
    "budget_levels",
    "F14 F13",
    "o_orderkey:i usage:f8 status:s",
    """SELECT o_orderkey, round(o_totalprice / 333333, 8) AS usage,
    CASE WHEN round(o_totalprice / 333333, 8) > 1 THEN 'over_free_tier' WHEN round(o_totalprice / 333333, 8) >= 0.8 THEN 'warning' ELSE 'within_free_tier' END AS status FROM orders""",
)
def budget_levels(spark: SparkSession, sf: str) -> DataFrame:
    usage = prices.ratio(F.col("o_totalprice"), F.lit(333333))
    return views.table(spark, sf, "orders").select(
        "o_orderkey", usage.alias("usage"), prices.budget_status(usage).alias("status")
    )


@query(
    "content_hashes",
    "F15",
    "doc_id:i sha:s bytes:i",
    "SELECT doc_id, sha256(text) AS sha, strlen(text) AS bytes FROM documents",
)
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select(
        "doc_id", hashing.content_sha(F.col("text")).alias("sha"), F.octet_length("text").alias("bytes")
    )


@query(
    "gate_maps",
    "F17 A28",
    "o_orderkey:i blockers:s headers:s",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice > 100000 THEN 'large' END, CASE WHEN NOT o_orderstatus = 'O' THEN 'open' END) AS blockers,
    'content-type,etag' AS headers FROM orders""",
)
def gate_maps(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.operators.gates import blockers, gate_map

    gates = gate_map({"large": F.col("o_totalprice") > 100000, "open": F.col("o_orderstatus") == "O"})
    headers = F.create_map(
        F.lit("etag"),
        F.col("o_orderkey").cast("string"),
        F.lit("server"),
        F.col("o_orderstatus"),
        F.lit("content-type"),
        F.lit("application/json"),
    )
    kept = F.array_join(F.sort_array(F.map_keys(text.allowed_headers(headers))), ",")
    return views.table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(blockers(gates), ",").alias("blockers"), kept.alias("headers")
    )


@query(
    "json_round_trip",
    "F18",
    "event_id:i k:i missing:i again:s",
    """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, -1 AS missing, '{"k":' || CAST(props ->> '$.k' AS BIGINT) || '}' AS again FROM events""",
)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint, absent bigint")
    return (
        views.table(spark, sf, "events")
        .withColumn("p", parsed)
        .select(
            "event_id",
            F.col("p.k").alias("k"),
            F.coalesce("p.absent", F.lit(-1)).alias("missing"),
            F.to_json(F.struct("p.k")).alias("again"),
        )
    )


@query(
    "typed_coercion",
    "F19 F20",
    "l_orderkey:i l_linenumber:i optional_int:i quantity:f6 money:f2",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS optional_int,
    CASE WHEN l_linenumber NOT IN (2, 3) AND l_quantity <= 40 THEN l_quantity END AS quantity, round(l_extendedprice * 2, 2) AS money FROM lineitem""",
)
def typed_coercion(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw_id = F.when(n == 1, "n/a").otherwise(F.col("l_partkey").cast("string"))
    raw_quantity = (
        F.when(n == 2, "-3").when(n == 3, "many").otherwise(F.col("l_quantity").cast("string"))
    )
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        n,
        raw_id.try_cast("bigint").alias("optional_int"),
        text.positive_number(raw_quantity, 40.0).alias("quantity"),
        F.round(F.col("l_extendedprice") * 2, 2).alias("money"),
    )


@query(
    "list_parameters",
    "F21",
    "n_nationkey:i items:s games:i inception:s",
    """SELECT n_nationkey, n_name || '|b' AS items, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS games,
    DATE '2026-07-20' + n_nationkey AS inception FROM nation""",
)
def list_parameters(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit(date(2026, 7, 20)), F.col("n_nationkey")).cast("string")
    listed = F.concat(F.lit(" "), F.col("n_name"), F.lit(" ,, b ,"))
    pairs = F.concat(
        F.lit("magic="), day, F.when(F.col("n_nationkey") % 2 == 0, ", pokemon=2026-08-01").otherwise(", pokemon=soon")
    )
    found = text.inception_map(pairs)
    return views.table(spark, sf, "nation").select(
        "n_nationkey",
        F.array_join(text.split_list(listed), "|").alias("items"),
        F.size(found).alias("games"),
        F.element_at(found, "magic").alias("inception"),
    )


@query(
    "array_operations",
    "F16",
    "o_custkey:i orders:i open_orders:i largest_first:s",
    """SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open_orders,
    string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey) AS largest_first FROM orders GROUP BY 1""",
)
def array_operations(spark: SparkSession, sf: str) -> DataFrame:
    # A customer's orders are one array, as the operation asks; its length is that of the result.
    placed = F.struct((-F.col("o_totalprice")).alias("falling"), "o_orderkey", "o_orderstatus")
    listed = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(placed)).alias("all"))
    return listed.select(
        "o_custkey",
        F.size("all").alias("orders"),
        F.size(F.filter("all", lambda s: s["o_orderstatus"] == "O")).alias("open_orders"),
        F.array_join(F.transform("all", lambda s: s["o_orderkey"].cast("string")), ",").alias("largest_first"),
    )


@query(
    "alias_resolution",
    "P11",
    "c_custkey:i first_value:s with_default:s",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS first_value,
    CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS with_default FROM customer""",
)
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    blank = F.when(k % 3 == 0, "")
    maybe = F.when(k % 2 == 0, F.col("c_name"))
    return views.table(spark, sf, "customer").select(
        k,
        text.first_present(blank, F.col("c_mktsegment")).alias("first_value"),
        text.first_present(F.lit(None).cast("string"), maybe, default=F.lit("none")).alias("with_default"),
    )
