"""Eligibility gates, liquidity ranks and buffered monthly selection."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import lenient_date
from pricetide.functions.ids import variant_id
from pricetide.operators.liquidity import score_liquidity
from pricetide.operators.ranking import rank_within
from pricetide.params import Methodology, with_cutoffs

LIQUIDITY_ORDER = (("liquidity_score", True), ("avg30", True), ("stable_variant_id", False))


def liquidity_order() -> list[Column]:
    """Score and reference price descending, then stable id ascending (code point order)."""
    return [F.desc(c) if down else F.asc(c) for c, down in LIQUIDITY_ORDER]


def catalogue_dates(products: DataFrame) -> DataFrame:
    """Day each product is known from: the source date, else first_seen; bad dates drop out."""
    raw = F.coalesce(
        F.when(F.col("source_date_added") != "", F.col("source_date_added")),
        F.col("first_seen").cast("string"),
    )
    return products.select(
        "game_key", "cm_product_id", lenient_date(raw).alias("added_on")
    ).filter(F.col("added_on").isNotNull())


def gate_failures(method: Methodology) -> Column:
    """Names of the eligibility gates a scored row (with `added_on`) fails."""
    cutoff = F.date_sub("effective_date", method.seasoning_days)
    checks = [
        ("seasoning", F.coalesce(F.col("added_on") <= cutoff, F.lit(False))),
        ("history_days", F.col("history_days") >= method.min_history_days),
        ("observation_ratio", F.col("observation_ratio") >= method.min_observation_ratio),
        ("price_floor_ratio", F.col("price_floor_ratio") >= method.price_floor_observation_ratio),
        ("suspect_zero_ratio", F.col("suspect_zero_ratio") <= method.max_suspect_zero_ratio),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(label)) for label, ok in checks]))


def gated(scores: DataFrame, products: DataFrame, method: Methodology) -> DataFrame:
    """Scores with `added_on` and the list of failed gates (empty = eligible)."""
    joined = scores.join(catalogue_dates(products), ["game_key", "cm_product_id"], "left")
    return joined.withColumn("failed_gates", gate_failures(method))


def eligible(scores: DataFrame, products: DataFrame, method: Methodology) -> DataFrame:
    """Scores that pass every gate."""
    return (
        gated(scores, products, method)
        .filter(F.size("failed_gates") == 0)
        .drop("failed_gates", "added_on")
    )


def ranked_candidates(
    prices: DataFrame,
    products: DataFrame,
    definitions: DataFrame,
    method: Methodology,
    effective_dates: list[date] | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Eligible variants with their rank per (index, effective date), checkpointed.

    `scores`, where given, are used instead of scoring the prices.
    """
    if scores is None:
        scores = score_liquidity(prices, definitions, method.selection_lookback_days, effective_dates)
    pool = eligible(scores, products, method).select(
        "index_code",
        "effective_date",
        "game_key",
        "cm_product_id",
        "variant_key",
        "stable_variant_id",
        "liquidity_score",
        "avg30",
    )
    return rank_within(pool, ["index_code", "effective_date"], liquidity_order())


def snapshot_fingerprints(ranked: DataFrame) -> DataFrame:
    """Eligible count and content hash of each ranked list.

    The rank is part of every row's hash, so an order-free sum identifies the
    ordered list without gathering it. A row's hash is 60 bits of the SHA-256 of its rank,
    id, and score and price in whole billionths and hundred-millionths.
    """

    def whole(name: str, scale: float) -> Column:
        return F.coalesce(F.round(F.col(name) * scale).cast("bigint").cast("string"), F.lit(""))

    text = F.concat_ws("|", F.col("rank").cast("string"), "stable_variant_id", whole("liquidity_score", 1e9), whole("avg30", 1e8))
    row = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    listed = ranked.groupBy("index_code", "effective_date").agg(
        F.count(F.lit(1)).alias("eligible_count"), F.sum(row).alias("_sum")
    )
    content = F.concat_ws("|", "index_code", F.col("eligible_count").cast("string"), F.col("_sum").cast("string"))
    return listed.withColumn("snapshot_sha256", F.sha2(content, 256)).drop("_sum")


_PICKED = (
    "index_code string, effective_date date, cm_product_id bigint, variant_key string,"
    " rank int, incumbent boolean, first_selection boolean"
)


def incumbent_fold() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The per-index fold over months, as one self-contained function.

    It is built here rather than at module level so that Spark ships its code to
    the executors, which then need not have this package installed.
    """
    columns = ["index_code", "effective_date", "cm_product_id", "variant_key", "rank"]
    flags = ["incumbent", "first_selection"]

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        incumbents: set[tuple[int, str]] = set()
        picked = []
        for _, month in pool.groupby("effective_date", sort=True):
            target = int(month["target_size"].iat[0])
            if len(month) < target:
                continue  # too few candidates: no rebalance, incumbents stay
            held = [k in incumbents for k in zip(month["cm_product_id"], month["variant_key"])]
            month = month.assign(incumbent=held, first_selection=not incumbents)
            limit = month["entry_cutoff"].where(~month["incumbent"], month["retention_cutoff"])
            # Ordering by (preferred, rank) and keeping the target size equals taking
            # the preferred ranks first and filling up with the best others.
            month = month.assign(late=month["rank"] > limit)
            chosen = month.sort_values(["late", "rank"]).head(target)
            picked.append(chosen[columns + flags])
            incumbents = set(zip(chosen["cm_product_id"], chosen["variant_key"]))
        return pd.concat(picked, ignore_index=True) if picked else pd.DataFrame(columns=columns + flags)

    return fold


def reachable(ranked: DataFrame, definitions: DataFrame, method: Methodology) -> DataFrame:
    """Candidates a selection can take: ranks up to max(N, ceil(1.2 N)).

    Exact, because fills only ever reach rank N and incumbents rank ceil(1.2 N);
    it bounds the fold input to that many rows per index and month.
    """
    limits = (
        with_cutoffs(definitions, method).select(
            "index_code", "target_size", "retention_cutoff", "entry_cutoff"
        )
    )
    return ranked.join(limits, "index_code").filter(
        F.col("rank") <= F.greatest("target_size", "retention_cutoff")
    )


def label_members(picked: DataFrame) -> DataFrame:
    """Action and reason of each selected member."""
    rank = F.col("rank").cast("string")
    action = F.when(F.col("incumbent"), "retained").otherwise("added")
    reason = (
        F.when(F.col("incumbent"), F.concat(F.lit("incumbent retained at liquidity rank "), rank))
        .when(
            F.col("first_selection") | (F.col("rank") <= F.col("entry_cutoff")),
            F.concat(F.lit("entrant selected at liquidity rank "), rank),
        )
        .otherwise(
            F.concat(F.lit("entrant selected to maintain target size at liquidity rank "), rank)
        )
    )
    return picked.withColumn("action", action).withColumn("reason", reason)


def removal_reason(rank: Column) -> Column:
    return F.when(
        rank.isNotNull(),
        F.concat(
            F.lit("incumbent removed at liquidity rank "),
            rank.cast("string"),
            F.lit(" outside selection buffer"),
        ),
    ).otherwise("incumbent removed after failing current eligibility gates")


def select_members(ranked: DataFrame, definitions: DataFrame, method: Methodology) -> DataFrame:
    """Members of every rebalance of every index, incumbents carried month to month."""
    pool = reachable(ranked, definitions, method)
    picked = (
        pool.select(
            "index_code",
            "effective_date",
            "cm_product_id",
            "variant_key",
            "rank",
            "target_size",
            "retention_cutoff",
            "entry_cutoff",
        )
        .groupBy("index_code")
        .applyInPandas(incumbent_fold(), _PICKED)
    )
    keys = ["index_code", "effective_date", "cm_product_id", "variant_key", "rank"]
    labelled = label_members(
        picked.join(
            pool.select(*keys, "stable_variant_id", "liquidity_score", "avg30", "entry_cutoff"), keys
        )
    )
    return labelled.select(
        "index_code",
        "effective_date",
        "cm_product_id",
        "variant_key",
        "stable_variant_id",
        "action",
        "reason",
        "liquidity_score",
        F.col("avg30").alias("ref_price"),
        "rank",
    )


def rebalance_steps(members: DataFrame) -> DataFrame:
    """(index, effective date, next effective date) of each rebalance."""
    order = Window.partitionBy("index_code").orderBy("effective_date")
    return (
        members.select("index_code", "effective_date")
        .distinct()
        .withColumn("next_date", F.lead("effective_date").over(order))
    )


def left_behind(members: DataFrame) -> DataFrame:
    """Incumbents a rebalance did not keep: previous members minus current ones."""
    steps = rebalance_steps(members).filter(F.col("next_date").isNotNull())
    incumbents = members.join(steps, ["index_code", "effective_date"]).select(
        "index_code", F.col("next_date").alias("effective_date"), "cm_product_id", "variant_key"
    )
    keys = ["index_code", "effective_date", "cm_product_id", "variant_key"]
    return incumbents.join(members.select(*keys), keys, "left_anti")


def removed_members(members: DataFrame, ranked: DataFrame, definitions: DataFrame) -> DataFrame:
    """Removal records with the removed incumbent's current rank, if it still has one."""
    keys = ["index_code", "effective_date", "cm_product_id", "variant_key"]
    gone = left_behind(members)
    games = definitions.select("index_code", "game_key")
    return (
        gone.join(ranked.select(*keys, "rank"), keys, "left")
        .join(games, "index_code")
        .select(
            *keys,
            F.lit("removed").alias("action"),
            removal_reason(F.col("rank")).alias("reason"),
            variant_id(F.col("game_key"), F.col("cm_product_id"), F.col("variant_key")).alias(
                "stable_variant_id"
            ),
        )
    )


def select_constituents(
    prices: DataFrame,
    products: DataFrame,
    definitions: DataFrame,
    method: Methodology,
    effective_date: date,
    incumbents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selection of every index for one date: (members, removed, summary).

    `incumbents` holds (index_code, cm_product_id, variant_key). One date needs no
    fold: preference is a join with the incumbents and the cut is a rank. Unlike
    `monthly_rebalances`, an index with too few candidates still gets what there is.
    """
    spark = prices.sparkSession
    open_definitions = definitions.withColumn("base_date", F.lit(effective_date))
    ranked = ranked_candidates(prices, products, open_definitions, method, [effective_date])
    keys = ["index_code", "cm_product_id", "variant_key"]
    if incumbents is None:
        incumbents = spark.createDataFrame([], "index_code string, cm_product_id bigint, variant_key string")
    held = incumbents.select(*keys).distinct().withColumn("incumbent", F.lit(True))
    any_held = held.groupBy("index_code").agg(F.lit(False).alias("first_selection"))
    pool = (
        reachable(ranked, definitions, method)
        .join(held, keys, "left")
        .join(any_held, "index_code", "left")
        .fillna({"incumbent": False, "first_selection": True})
    )
    limit = F.when(F.col("incumbent"), F.col("retention_cutoff")).otherwise(F.col("entry_cutoff"))
    # The pool holds at most max(N, ceil(1.2 N)) rows per index.
    order = Window.partitionBy("index_code").orderBy(F.col("rank") > limit, "rank")
    chosen = (
        pool.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("target_size"))
    )
    members = label_members(chosen).select(
        "index_code",
        "effective_date",
        "cm_product_id",
        "variant_key",
        "stable_variant_id",
        "action",
        "reason",
        "liquidity_score",
        F.col("avg30").alias("ref_price"),
        "rank",
        "place",
    )
    gone = held.select(*keys).join(members.select(*keys), keys, "left_anti")
    games = definitions.select("index_code", "game_key")
    removed = (
        gone.join(ranked.select(*keys, "rank"), keys, "left")
        .join(games, "index_code")
        .select(
            "index_code",
            F.lit(effective_date).alias("effective_date"),
            "cm_product_id",
            "variant_key",
            F.lit("removed").alias("action"),
            removal_reason(F.col("rank")).alias("reason"),
            variant_id(F.col("game_key"), F.col("cm_product_id"), F.col("variant_key")).alias(
                "stable_variant_id"
            ),
        )
    )
    summary = (
        definitions.select("index_code")
        .join(snapshot_fingerprints(ranked).drop("effective_date"), "index_code", "left")
        .fillna({"eligible_count": 0})
    )
    return members, removed, summary


def monthly_rebalances(
    prices: DataFrame,
    products: DataFrame,
    definitions: DataFrame,
    method: Methodology,
    run_date: date | None = None,
    scores: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All monthly rebalances of all indexes: (rebalances, members, removed).

    Every month of every index is scored and ranked in one job; only the best
    ranks go through the sequential fold, one group per index. `scores` at all month
    starts, as stored summaries give them, stand in for scoring the prices.
    """
    if run_date is not None:
        prices = prices.filter(F.col("value_date") <= F.lit(run_date))
    ranked = ranked_candidates(prices, products, definitions, method, scores=scores)
    if run_date is not None:
        ranked = ranked.filter(F.col("effective_date") <= F.lit(run_date))
    members = select_members(ranked, definitions, method)
    removed = removed_members(members, ranked, definitions)
    rebalances = (
        members.select("index_code", "effective_date")
        .distinct()
        .join(snapshot_fingerprints(ranked), ["index_code", "effective_date"])
        .withColumn("methodology_version", F.lit(method.methodology_version))
        .select(
            "index_code", "effective_date", "methodology_version", "snapshot_sha256", "eligible_count"
        )
    )
    return rebalances, members, removed
