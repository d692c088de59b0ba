"""Liquidity scoring, eligibility, ranking and selection queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import chain, liquidity, ranking, selection
from pricetide.params import with_cutoffs
from pricetide.plans.summaries import refresh_summaries, stored_scores
from pricetide.queries import views
from pricetide.queries.registry import query
from pricetide.sinks.versions import VersionedTable

views.SQL.update(
    {
        "months": (
            ["price_panel"],
            """SELECT DISTINCT CAST(date_trunc('month', value_date) + INTERVAL (i) MONTH AS DATE) AS effective_date
            FROM price_panel, (VALUES (1), (2), (3)) t(i)""",
        ),
        "scoring_rows": (
            ["price_panel", "definitions", "months"],
            """SELECT d.index_code, m.effective_date, d.min_price, p.*, coalesce(p.price_avg, p.price_low) AS used,
            lag(p.price_avg) OVER (PARTITION BY d.index_code, m.effective_date, p.stable_variant_id ORDER BY p.value_date) AS before
            FROM price_panel p JOIN definitions d ON d.game_key = p.game_key AND d.product_kind = p.product_kind
            JOIN months m ON p.value_date < m.effective_date AND p.value_date >= m.effective_date - 60 AND m.effective_date >= d.base_date""",
        ),
        "score_sums": (
            ["scoring_rows"],
            """SELECT index_code, effective_date, game_key, product_kind, cm_product_id, variant_key, stable_variant_id,
            count(*) FILTER (price_avg > 0) AS primary_observation_days, count(*) FILTER (used >= min_price) AS price_floor_days,
            count(*) FILTER (used <= 0) AS suspect_zero_days, count(*) FILTER (price_avg <> before) AS price_update_days,
            avg(CASE WHEN price_avg > 0 AND price_low IS NOT NULL THEN 1 - least(1, greatest(0, abs(price_low - price_avg) / price_avg)) ELSE 0 END) AS inverse_dispersion,
            count(used) AS history_days, min(value_date) AS first_observation_date, max(value_date) AS last_observation_date,
            arg_max(avg30, value_date) FILTER (avg30 IS NOT NULL) AS source_avg30, avg(used) AS mean_used_price
            FROM scoring_rows GROUP BY ALL""",
        ),
        "scores": (
            ["score_sums"],
            """SELECT *, greatest(0, least(1, 0.5::DOUBLE * observation_ratio + 0.3::DOUBLE * price_update_frequency + 0.2::DOUBLE * inverse_dispersion)) AS liquidity_score
            FROM (SELECT *, primary_observation_days / 60.0::DOUBLE AS observation_ratio, price_floor_days / 60.0::DOUBLE AS price_floor_ratio,
                  suspect_zero_days / 60.0::DOUBLE AS suspect_zero_ratio, price_update_days / 59.0::DOUBLE AS price_update_frequency,
                  coalesce(source_avg30, mean_used_price) AS avg30 FROM score_sums)""",
        ),
        "gated": (
            ["scores", "products"],
            """SELECT s.*, p.added_on, concat_ws(',',
            CASE WHEN NOT coalesce(p.added_on <= s.effective_date - 90, false) THEN 'seasoning' END,
            CASE WHEN history_days < 8 THEN 'history_days' END, CASE WHEN observation_ratio < 0.1::DOUBLE THEN 'observation_ratio' END,
            CASE WHEN price_floor_ratio < 0.1::DOUBLE THEN 'price_floor_ratio' END, CASE WHEN suspect_zero_ratio > 0.05::DOUBLE THEN 'suspect_zero_ratio' END) AS failed
            FROM scores s LEFT JOIN products p ON p.game_key = s.game_key AND p.cm_product_id = s.cm_product_id""",
        ),
        "ranked": (
            ["gated"],
            """SELECT index_code, effective_date, cm_product_id, variant_key, stable_variant_id, liquidity_score, avg30,
            row_number() OVER (PARTITION BY index_code, effective_date ORDER BY liquidity_score DESC, avg30 DESC, stable_variant_id) AS rank
            FROM gated WHERE failed = ''""",
        ),
        "qualified": (
            ["ranked", "definitions"],
            """SELECT *, row_number() OVER (PARTITION BY index_code ORDER BY effective_date) AS step
            FROM (SELECT index_code, effective_date FROM ranked JOIN definitions USING (index_code) GROUP BY 1, 2 HAVING count(*) >= max(target_size))""",
        ),
        "fold": (
            ["qualified", "ranked", "definitions"],
            """SELECT index_code, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS ids FROM definitions
            UNION ALL
            SELECT f.index_code, f.step + 1, (list(r.stable_variant_id ORDER BY
              CASE WHEN r.rank <= CASE WHEN list_contains(f.ids, r.stable_variant_id) THEN d.retention_cutoff ELSE d.entry_cutoff END THEN 0 ELSE 1 END, r.rank))[1:any_value(d.target_size)]
            FROM fold f JOIN qualified q ON q.index_code = f.index_code AND q.step = f.step + 1
            JOIN ranked r ON r.index_code = q.index_code AND r.effective_date = q.effective_date
            JOIN definitions d ON d.index_code = f.index_code GROUP BY f.index_code, f.step""",
        ),
        "fold_members": (
            ["fold", "qualified", "ranked", "definitions"],
            """SELECT r.*, s.step, CASE WHEN s.held THEN 'retained' ELSE 'added' END AS action,
            CASE WHEN s.held THEN 'incumbent retained at liquidity rank ' || r.rank
                 WHEN s.first OR r.rank <= d.entry_cutoff THEN 'entrant selected at liquidity rank ' || r.rank
                 ELSE 'entrant selected to maintain target size at liquidity rank ' || r.rank END AS reason
            FROM (SELECT f.index_code, f.step, unnest(f.ids) AS sid, p.ids AS before, len(p.ids) = 0 AS first, list_contains(p.ids, unnest(f.ids)) AS held
                  FROM fold f JOIN fold p ON p.index_code = f.index_code AND p.step = f.step - 1) s
            JOIN qualified q ON q.index_code = s.index_code AND q.step = s.step
            JOIN ranked r ON r.index_code = q.index_code AND r.effective_date = q.effective_date AND r.stable_variant_id = s.sid
            JOIN definitions d ON d.index_code = s.index_code""",
        ),
    }
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return liquidity.score_liquidity(
        views.price_panel(spark, sf), views.definitions(spark), views.METHOD.selection_lookback_days
    )


def _rebalances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return selection.monthly_rebalances(
        views.price_panel(spark, sf), views.products(spark, sf), views.definitions(spark), views.METHOD
    )


@query(
    "liquidity_scores",
    "A1 A2 W1 F12 P3",
    "index_code:s effective_date:s stable_variant_id:s primary_observation_days:i price_floor_days:i suspect_zero_days:i"
    " price_update_days:i inverse_dispersion:f8 history_days:i first_observation_date:s last_observation_date:s"
    " source_avg30:f8 mean_used_price:f6 liquidity_score:f8",
    "SELECT * FROM scores",
    ["scores"],
)
def liquidity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query(
    "stored_liquidity_scores",
    "A1 A2 W1 F12 P3",
    "index_code:s effective_date:s stable_variant_id:s primary_observation_days:i price_floor_days:i suspect_zero_days:i"
    " price_update_days:i inverse_dispersion:f8 history_days:i first_observation_date:s last_observation_date:s"
    " source_avg30:f8 mean_used_price:f6 liquidity_score:f8",
    "SELECT * FROM scores",
    ["scores"],
)
def stored_liquidity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from monthly summaries, stored for all but the newest month and then brought up to date."""
    panel = views.price_panel(spark, sf).withColumn("month", F.date_format("value_date", "yyyy-MM"))
    definitions, lookback = views.definitions(spark), views.METHOD.selection_lookback_days
    prices = VersionedTable(spark, views.scratch(spark), panel.schema, ["game_key", "month"], ["stable_variant_id", "value_date"])
    path = views.scratch(spark)
    newest = panel.agg(F.max("month")).first()[0] or ""
    prices.replace(panel.where(F.col("month") < newest))
    refresh_summaries(spark, path, prices, definitions, lookback)
    prices.replace_partitions(panel.where(F.col("month") == newest))
    return stored_scores(refresh_summaries(spark, path, prices, definitions, lookback), definitions, lookback)


@query(
    "price_changes_by_part",
    "W1",
    "cm_product_id:i variant_key:s value_date:s changed:b",
    """SELECT l_partkey AS cm_product_id, variant_key, value_date, coalesce(price <> lag(price) OVER (PARTITION BY l_partkey, variant_key ORDER BY value_date), false) AS changed
    FROM (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'foil' ELSE 'nonfoil' END AS variant_key, CAST(l_shipdate AS DATE) AS value_date,
          max(l_quantity) AS price FROM lineitem GROUP BY 1, 2, 3)""",
)
def price_changes_by_part(spark: SparkSession, sf: str) -> DataFrame:
    prices = (
        views.table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("cm_product_id"),
            views.variant_of(F.col("l_returnflag")).alias("variant_key"),
            F.to_date("l_shipdate").alias("value_date"),
        )
        .agg(F.max("l_quantity").alias("price_avg"))
    )
    rows = prices.select(
        F.lit("onepiece").alias("game_key"),
        F.lit("single").alias("product_kind"),
        F.concat_ws(":", "cm_product_id", "variant_key").alias("stable_variant_id"),
        "cm_product_id",
        "variant_key",
        "value_date",
        "price_avg",
        F.lit(None).cast("double").alias("price_low"),
        F.lit(None).cast("double").alias("avg30"),
    )
    return liquidity.observation_days(rows).withColumn(
        "changed", F.coalesce(F.col("price_avg") != F.col("previous_avg"), F.lit(False))
    )


@query(
    "eligibility_gates",
    "P4 J2",
    "index_code:s effective_date:s stable_variant_id:s failed:s",
    "SELECT * FROM gated",
    ["gated"],
)
def eligibility_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.gated(_scores(spark, sf), views.products(spark, sf), views.METHOD)
    return rows.withColumn("failed", F.array_join("failed_gates", ","))


@query(
    "catalogue_dates",
    "J2 F3",
    "game_key:s cm_product_id:i added_on:s",
    "SELECT * FROM products WHERE added_on IS NOT NULL",
    ["products"],
)
def catalogue_dates(spark: SparkSession, sf: str) -> DataFrame:
    return selection.catalogue_dates(views.products(spark, sf))


@query(
    "ranked_candidates",
    "W8 T1 P4",
    "index_code:s effective_date:s stable_variant_id:s rank:i liquidity_score:f8 avg30:f6",
    "SELECT * FROM ranked",
    ["ranked"],
)
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return selection.ranked_candidates(
        views.price_panel(spark, sf), views.products(spark, sf), views.definitions(spark), views.METHOD
    )


@query(
    "whole_table_ranks",
    "W8 T1",
    "l_returnflag:s l_orderkey:i l_linenumber:i l_extendedprice:f2 rank:i",
    """SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax) AS rank FROM lineitem""",
)
def whole_table_ranks(spark: SparkSession, sf: str) -> DataFrame:
    order = [
        F.desc("l_extendedprice"),
        *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")],
    ]
    return ranking.rank_within(views.table(spark, sf, "lineitem"), ["l_returnflag"], order)


@query(
    "monthly_selection",
    "D1 D2 ST6 T2 P17 F7",
    "index_code:s effective_date:s cm_product_id:i variant_key:s stable_variant_id:s action:s reason:s liquidity_score:f8 ref_price:f6 rank:i",
    "SELECT *, avg30 AS ref_price FROM fold_members",
    ["fold_members"],
)
def monthly_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _rebalances(spark, sf)[1]


@query(
    "monthly_removals",
    "U3 P17 D2",
    "index_code:s effective_date:s cm_product_id:i variant_key:s action:s reason:s stable_variant_id:s",
    """SELECT m.index_code, q.effective_date, m.cm_product_id, m.variant_key, 'removed' AS action, m.stable_variant_id,
    CASE WHEN r.rank IS NOT NULL THEN 'incumbent removed at liquidity rank ' || r.rank || ' outside selection buffer'
         ELSE 'incumbent removed after failing current eligibility gates' END AS reason
    FROM fold_members m JOIN qualified q ON q.index_code = m.index_code AND q.step = m.step + 1
    LEFT JOIN ranked r ON r.index_code = m.index_code AND r.effective_date = q.effective_date AND r.stable_variant_id = m.stable_variant_id
    WHERE NOT EXISTS (SELECT 1 FROM fold_members n WHERE n.index_code = m.index_code AND n.step = m.step + 1 AND n.stable_variant_id = m.stable_variant_id)""",
    ["fold_members", "qualified", "ranked"],
)
def monthly_removals(spark: SparkSession, sf: str) -> DataFrame:
    return _rebalances(spark, sf)[2]


# The fingerprint adds up hashes of the rows' text, so SQL can say it too.
_SNAPSHOT = (
    "sha256(index_code || '|' || count(*) || '|' || sum(('0x' || substr(sha256(rank || '|' || stable_variant_id || '|' ||"
    " coalesce(CAST(round(liquidity_score * 1e9) AS BIGINT)::VARCHAR, '') || '|' ||"
    " coalesce(CAST(round(avg30 * 1e8) AS BIGINT)::VARCHAR, '')), 1, 15))::BIGINT::HUGEINT))"
)


@query(
    "monthly_rebalance_headers",
    "D2 A27",
    "index_code:s effective_date:s eligible_count:i methodology_version:s snapshot:s",
    f"""SELECT index_code, effective_date, count(*) AS eligible_count, '1.3.0' AS methodology_version, {_SNAPSHOT} AS snapshot FROM ranked JOIN qualified USING (index_code, effective_date) GROUP BY 1, 2""",
    ["ranked", "qualified"],
)
def monthly_rebalance_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _rebalances(spark, sf)[0].withColumnRenamed("snapshot_sha256", "snapshot")


@query(
    "selection_snapshot",
    "A27 F15",
    "index_code:s effective_date:s eligible_count:i snapshot:s",
    f"SELECT index_code, effective_date, count(*) AS eligible_count, {_SNAPSHOT} AS snapshot FROM ranked GROUP BY 1, 2",
    ["ranked"],
)
def selection_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    ranked = selection.ranked_candidates(
        views.price_panel(spark, sf), views.products(spark, sf), views.definitions(spark), views.METHOD
    )
    return selection.snapshot_fingerprints(ranked).withColumnRenamed("snapshot_sha256", "snapshot")


_DAY = date(1998, 3, 1)
_HELD = """held AS (SELECT index_code, cm_product_id, variant_key FROM basket WHERE effective_date = DATE '1998-02-01')"""
_CHOSEN = f"""(WITH {_HELD} SELECT r.*, h.cm_product_id IS NOT NULL AS held, d.entry_cutoff, d.target_size,
    NOT EXISTS (SELECT 1 FROM held x WHERE x.index_code = r.index_code) AS nobody,
    row_number() OVER (PARTITION BY r.index_code ORDER BY CASE WHEN r.rank <= CASE WHEN h.cm_product_id IS NOT NULL THEN d.retention_cutoff ELSE d.entry_cutoff END THEN 0 ELSE 1 END, r.rank) AS place
    FROM ranked r JOIN definitions d USING (index_code) LEFT JOIN held h USING (index_code, cm_product_id, variant_key) WHERE r.effective_date = DATE '1998-03-01')"""


@query(
    "single_date_selection",
    "D1 T2 P17",
    "index_code:s cm_product_id:i variant_key:s action:s reason:s rank:i place:i ref_price:f6",
    f"""SELECT *, avg30 AS ref_price, CASE WHEN held THEN 'retained' ELSE 'added' END AS action,
    CASE WHEN held THEN 'incumbent retained at liquidity rank ' || rank WHEN nobody OR rank <= entry_cutoff THEN 'entrant selected at liquidity rank ' || rank
         ELSE 'entrant selected to maintain target size at liquidity rank ' || rank END AS reason FROM {_CHOSEN} WHERE place <= target_size""",
    ["ranked", "definitions", "basket"],
)
def single_date_selection(spark: SparkSession, sf: str) -> DataFrame:
    held = views.basket(spark, sf).filter(F.col("effective_date") == F.lit(date(1998, 2, 1)))
    return selection.select_constituents(
        views.price_panel(spark, sf),
        views.products(spark, sf),
        views.definitions(spark),
        views.METHOD,
        _DAY,
        held,
    )[0]


@query(
    "single_date_removals",
    "U3 P17 D1",
    "index_code:s cm_product_id:i variant_key:s reason:s",
    f"""SELECT b.index_code, b.cm_product_id, b.variant_key,
    CASE WHEN r.rank IS NOT NULL THEN 'incumbent removed at liquidity rank ' || r.rank || ' outside selection buffer' ELSE 'incumbent removed after failing current eligibility gates' END AS reason
    FROM basket b LEFT JOIN ranked r ON r.index_code = b.index_code AND r.stable_variant_id = b.stable_variant_id AND r.effective_date = DATE '1998-03-01'
    WHERE b.effective_date = DATE '1998-02-01' AND NOT EXISTS (SELECT 1 FROM {_CHOSEN} c WHERE c.place <= c.target_size AND c.index_code = b.index_code AND c.stable_variant_id = b.stable_variant_id)""",
    ["ranked", "definitions", "basket"],
)
def single_date_removals(spark: SparkSession, sf: str) -> DataFrame:
    held = views.basket(spark, sf).filter(F.col("effective_date") == F.lit(date(1998, 2, 1)))
    return selection.select_constituents(
        views.price_panel(spark, sf),
        views.products(spark, sf),
        views.definitions(spark),
        views.METHOD,
        _DAY,
        held,
    )[1]


@query(
    "buffer_cutoffs",
    "T2 F13 S5",
    "p_partkey:i retention_cutoff:i entry_cutoff:i",
    """SELECT p_partkey, CAST(ceil((p_size + 1) * 1.2::DOUBLE) AS BIGINT) AS retention_cutoff, greatest(1, CAST(floor((p_size + 1) * 0.9::DOUBLE) AS BIGINT)) AS entry_cutoff FROM part""",
)
def buffer_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    sizes = views.table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 1).alias("target_size"))
    return with_cutoffs(sizes, views.METHOD)


@query(
    "index_definitions",
    "S5 P12",
    "index_code:s game_key:s universe:s target_size:i language_scope_status:s prices:i",
    """SELECT d.index_code, d.game_key, d.universe, d.target_size, d.language_scope_status, count(p.value_date) AS prices
    FROM definitions d LEFT JOIN price_panel p ON p.game_key = d.game_key AND p.product_kind = d.product_kind
    WHERE d.game_key = 'onepiece' GROUP BY ALL""",
    ["definitions", "price_panel"],
)
def index_definitions(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.params import definitions_frame

    enabled = definitions_frame(spark, views.METHOD.enabled(["onepiece"]))
    prices = views.price_panel(spark, sf).groupBy("game_key", "product_kind").agg(F.count(F.lit(1)).alias("prices"))
    return enabled.join(prices, ["game_key", "product_kind"], "left").fillna({"prices": 0})


@query(
    "index_pipeline_values",
    "D8 D2 D3",
    "index_code:s value_date:s index_value:f4 daily_return:f8 n_constituents_active:i n_capped:i n_carried_forward:i n_stale:i rebalance_effective_date:s",
    "SELECT * FROM fold_daily_values",
    ["fold_daily_values"],
)
def index_pipeline_values(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.plans.indexes import calculate

    return calculate(
        views.price_panel(spark, sf),
        views.products(spark, sf),
        views.archive_calendar(spark, sf),
        views.METHOD,
    ).values


views.SQL["fold_panel"] = (
    ["fold_members", "qualified", "archive_calendar", "definitions", "price_panel"],
    """SELECT s.index_code, c.value_date, s.effective_date, c.unchanged, b.cm_product_id, b.variant_key, b.stable_variant_id,
    coalesce(p.price_avg, p.price_low) AS used_price
    FROM archive_calendar c JOIN definitions d USING (game_key)
    JOIN (SELECT *, lead(effective_date) OVER (PARTITION BY index_code ORDER BY effective_date) AS next_date FROM qualified) s
      ON s.index_code = d.index_code AND c.value_date >= s.effective_date AND (s.next_date IS NULL OR c.value_date < s.next_date)
    JOIN fold_members b ON b.index_code = s.index_code AND b.effective_date = s.effective_date
    LEFT JOIN price_panel p ON p.game_key = d.game_key AND p.cm_product_id = b.cm_product_id AND p.variant_key = b.variant_key AND p.value_date = c.value_date""",
)
views.SQL.update(views._chain_views("fold_panel", "fold_"))


@query(
    "left_behind_members",
    "U3",
    "index_code:s effective_date:s cm_product_id:i variant_key:s",
    "SELECT * FROM basket_removed",
    ["basket_removed"],
)
def left_behind_members(spark: SparkSession, sf: str) -> DataFrame:
    return selection.left_behind(views.basket(spark, sf))


@query(
    "price_days_per_game",
    "S10 D4",
    "game_key:s value_date:s unchanged:b",
    "SELECT DISTINCT game_key, value_date, false AS unchanged FROM price_panel",
    ["price_panel"],
)
def price_days_per_game(spark: SparkSession, sf: str) -> DataFrame:
    return chain.price_calendar(views.price_panel(spark, sf))


@query(
    "first_price_of_variant",
    "T6 A11",
    "stable_variant_id:s first_seen:s last_seen:s",
    "SELECT stable_variant_id, min(value_date) AS first_seen, max(value_date) AS last_seen FROM price_panel GROUP BY 1",
    ["price_panel"],
)
def first_price_of_variant(spark: SparkSession, sf: str) -> DataFrame:
    from pricetide.operators.normalize import latest_catalogue, variants_table

    return latest_catalogue(variants_table(views.price_panel(spark, sf)), "stable_variant_id")


