"""Membership and composition queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import membership, search
from pricetide.queries import views
from pricetide.queries.registry import query

_INTERVAL = (
    "index_code:s cm_product_id:i variant_key:s name:s set_name:s member_since:s removed_at:s action:s"
    " entry_reason:s removal_reason:s liquidity_score:f8 ref_price:f6"
)
_D1, _D2 = date(1997, 3, 15), date(1998, 9, 1)
_ON = "member_since <= DATE '{0}' AND (removed_at IS NULL OR removed_at > DATE '{0}')"

views.SQL.update(
    {
        "events": (
            ["intervals"],
            """SELECT index_code, cm_product_id, variant_key, member_since AS date, 'added' AS event FROM intervals
            UNION ALL SELECT index_code, cm_product_id, variant_key, removed_at, 'removed' FROM intervals WHERE removed_at IS NOT NULL""",
        ),
        "derived": (
            ["intervals", "events"],
            """SELECT e.index_code, e.date AS effective_date, e.additions, e.removals,
            (SELECT count(*) FROM intervals i WHERE i.index_code = e.index_code AND i.member_since <= e.date AND (i.removed_at IS NULL OR i.removed_at > e.date)) AS active_count
            FROM (SELECT index_code, date, count(*) FILTER (event = 'added') AS additions, count(*) FILTER (event = 'removed') AS removals FROM events GROUP BY 1, 2) e""",
        ),
        "derived_rebalances": (
            ["derived"],
            "SELECT *, greatest(active_count - additions, 0) AS retained_count FROM derived",
        ),
        "changes": (
            ["intervals", "basket_removed"],
            """SELECT index_code, member_since AS effective_date, cm_product_id, variant_key, 'added' AS action, entry_reason AS reason FROM intervals
            UNION ALL SELECT index_code, effective_date, cm_product_id, variant_key, 'removed', reason FROM basket_removed""",
        ),
    }
)


@query("membership_intervals", "A16 J8 D13", _INTERVAL, "SELECT * FROM intervals", ["intervals"])
def membership_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return views.intervals(spark, sf)


@query(
    "rebalance_records",
    "A17 D13 F16",
    "index_code:s effective_date:s active_count:i retained_count:i additions:i removals:i first_change:s",
    """SELECT b.index_code, b.effective_date, count(*) AS active_count, count(*) FILTER (action = 'retained') AS retained_count,
    any_value(c.additions) AS additions, any_value(c.removals) AS removals, any_value(c.first_change) AS first_change
    FROM basket b LEFT JOIN (SELECT index_code, effective_date, count(*) FILTER (action = 'added') AS additions, count(*) FILTER (action = 'removed') AS removals,
      arg_min(action || ':' || cm_product_id || ':' || variant_key, struct_pack(a := action, b := cm_product_id, c := variant_key)) AS first_change FROM changes GROUP BY 1, 2) c USING (index_code, effective_date)
    GROUP BY 1, 2""",
    ["basket", "changes"],
)
def rebalance_records(spark: SparkSession, sf: str) -> DataFrame:
    members, removed = views.basket(spark, sf), views.basket_removed(spark, sf)
    intervals = membership.lifecycle(members, removed)
    heads = members.select("index_code", "effective_date").distinct()
    records = membership.rebalance_records(
        heads, members, membership.rebalance_changes(intervals, removed)
    )
    first = F.get("changes", F.lit(0))
    return records.select(
        "*",
        F.when(F.col("changes").isNotNull(), F.size(F.filter("changes", lambda c: c["action"] == "added"))).alias("additions"),
        F.when(F.col("changes").isNotNull(), F.size(F.filter("changes", lambda c: c["action"] == "removed"))).alias("removals"),
        F.when(
            first.isNotNull(),
            F.concat_ws(":", first["action"], first["cm_product_id"].cast("string"), first["variant_key"]),
        ).alias("first_change"),
    )


@query(
    "rebalance_changes",
    "A17",
    "index_code:s effective_date:s cm_product_id:i variant_key:s action:s reason:s",
    "SELECT * FROM changes",
    ["changes"],
)
def rebalance_changes(spark: SparkSession, sf: str) -> DataFrame:
    removed = views.basket_removed(spark, sf)
    return membership.rebalance_changes(membership.lifecycle(views.basket(spark, sf), removed), removed)


@query(
    "members_as_of",
    "P5 D18",
    "index_code:s cm_product_id:i variant_key:s member_since:s removed_at:s",
    f"SELECT * FROM intervals WHERE {_ON.format(_D2)}",
    ["intervals"],
)
def members_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return membership.as_of(views.intervals(spark, sf), F.lit(_D2))


@query(
    "member_search",
    "P6 D18",
    "index_code:s cm_product_id:i variant_key:s name:s set_name:s member_since:s inactive:b",
    f"""SELECT *, false AS inactive FROM intervals WHERE {_ON.format(_D2)} AND (lower(name) LIKE '%set 1%' OR lower(set_name) LIKE '%set 1%' OR variant_key LIKE '%set 1%')
    UNION ALL SELECT *, true FROM intervals WHERE member_since <= DATE '{_D2}' AND (lower(name) LIKE '%1%' OR lower(set_name) LIKE '%1%' OR CAST(cm_product_id AS VARCHAR) LIKE '%1%')""",
    ["intervals"],
)
def member_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.intervals(spark, sf)
    active = membership.search(rows, F.lit(_D2), "  SET 1 ").withColumn("inactive", F.lit(False))
    ever = membership.search(rows, F.lit(_D2), "1", include_inactive=True).withColumn("inactive", F.lit(True))
    return active.unionByName(ever)


@query(
    "indexed_member_search",
    "P6 D18 K8",
    "index_code:s cm_product_id:i variant_key:s name:s set_name:s member_since:s inactive:b",
    f"""SELECT *, false AS inactive FROM intervals WHERE {_ON.format(_D2)} AND (lower(name) LIKE '%set 1%' OR lower(set_name) LIKE '%set 1%' OR variant_key LIKE '%set 1%')
    UNION ALL SELECT *, true FROM intervals WHERE member_since <= DATE '{_D2}' AND (lower(name) LIKE '%1%' OR lower(set_name) LIKE '%1%' OR CAST(cm_product_id AS VARCHAR) LIKE '%1%')""",
    ["intervals"],
)
def indexed_member_search(spark: SparkSession, sf: str) -> DataFrame:
    """The searches of `member_search` through a stored trigram index."""
    rows = views.intervals(spark, sf)
    index = search.MemberIndex(spark, views.scratch(spark))
    index.build(rows)
    active = index.search(rows, F.lit(_D2), "  SET 1 ").withColumn("inactive", F.lit(False))
    ever = index.search(rows, F.lit(_D2), "1", include_inactive=True).withColumn("inactive", F.lit(True))
    return active.unionByName(ever)


@query(
    "composition_delta",
    "J17 D18",
    "index_code:s cm_product_id:i variant_key:s name:s change:s",
    f"""SELECT index_code, cm_product_id, variant_key, coalesce(b.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'retained' END AS change
    FROM (SELECT * FROM intervals WHERE {_ON.format(_D1)}) a FULL JOIN (SELECT * FROM intervals WHERE {_ON.format(_D2)}) b USING (index_code, cm_product_id, variant_key)""",
    ["intervals"],
)
def composition_delta(spark: SparkSession, sf: str) -> DataFrame:
    return membership.composition_delta(views.intervals(spark, sf), F.lit(_D1), F.lit(_D2))


@query(
    "lifecycle_actions",
    "U8",
    "index_code:s cm_product_id:i variant_key:s date:s event:s",
    f"SELECT * FROM events WHERE date <= DATE '{_D2}'",
    ["events"],
)
def lifecycle_actions(spark: SparkSession, sf: str) -> DataFrame:
    return membership.actions(views.intervals(spark, sf)).filter(F.col("date") <= F.lit(_D2))


@query(
    "composition_dates",
    "U5",
    "index_code:s date:s",
    "SELECT index_code, date FROM events UNION SELECT index_code, base_date FROM definitions",
    ["events", "definitions"],
)
def composition_dates(spark: SparkSession, sf: str) -> DataFrame:
    return membership.composition_dates(views.intervals(spark, sf), views.definitions(spark))


@query(
    "latest_composition_date",
    "A26",
    "index_code:s latest_date:s",
    "SELECT d.index_code, greatest(max(e.date), any_value(d.base_date)) AS latest_date FROM definitions d LEFT JOIN events e USING (index_code) GROUP BY 1",
    ["events", "definitions"],
)
def latest_composition_date(spark: SparkSession, sf: str) -> DataFrame:
    return membership.latest_composition_date(views.intervals(spark, sf), views.definitions(spark))


@query(
    "derived_rebalances",
    "J20 A18",
    "index_code:s effective_date:s active_count:i retained_count:i additions:i removals:i",
    "SELECT * FROM derived_rebalances",
    ["derived_rebalances"],
)
def derived_rebalances(spark: SparkSession, sf: str) -> DataFrame:
    return membership.derived_rebalances(views.intervals(spark, sf))


@query(
    "derived_changes",
    "A18",
    "index_code:s effective_date:s cm_product_id:i variant_key:s action:s reason:s",
    """SELECT index_code, member_since AS effective_date, cm_product_id, variant_key, 'added' AS action, coalesce(entry_reason,
      CASE WHEN member_since = min(member_since) OVER (PARTITION BY index_code) THEN 'Initial composition' ELSE 'Entered the selection' END) AS reason FROM intervals
    UNION ALL SELECT index_code, removed_at, cm_product_id, variant_key, 'removed', coalesce(removal_reason, 'Left the selection') FROM intervals WHERE removed_at IS NOT NULL""",
    ["intervals"],
)
def derived_changes(spark: SparkSession, sf: str) -> DataFrame:
    return membership.derived_changes(views.intervals(spark, sf))


@query(
    "rebalances_by_week",
    "A19 F8 D18",
    "index_code:s period:s records:i additions:i removals:i retained:i",
    """SELECT index_code, strftime(effective_date, '%G-W%V') AS period, count(*) AS records, sum(additions) AS additions, sum(removals) AS removals, sum(retained_count) AS retained
    FROM derived_rebalances GROUP BY 1, 2""",
    ["derived_rebalances"],
)
def rebalances_by_week(spark: SparkSession, sf: str) -> DataFrame:
    return membership.group_rebalances(membership.derived_rebalances(views.intervals(spark, sf)), "week")


@query(
    "rebalances_by_month",
    "A19",
    "index_code:s period:s records:i additions:i removals:i retained:i",
    """SELECT index_code, strftime(effective_date, '%Y-%m') AS period, count(*) AS records, sum(additions) AS additions, sum(removals) AS removals, sum(retained_count) AS retained
    FROM derived_rebalances GROUP BY 1, 2""",
    ["derived_rebalances"],
)
def rebalances_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return membership.group_rebalances(membership.derived_rebalances(views.intervals(spark, sf)), "month")


@query(
    "change_lifecycle_rows",
    "J19",
    "index_code:s effective_date:s cm_product_id:i variant_key:s action:s member_since:s removed_at:s exact:b",
    """SELECT c.index_code, c.effective_date, c.cm_product_id, c.variant_key, c.action, i.member_since, i.removed_at, true AS exact FROM changes c
    JOIN intervals i ON i.index_code = c.index_code AND i.cm_product_id = c.cm_product_id AND i.variant_key = c.variant_key
     AND CASE WHEN c.action = 'added' THEN i.member_since ELSE i.removed_at END = c.effective_date""",
    ["changes", "intervals"],
)
def change_lifecycle_rows(spark: SparkSession, sf: str) -> DataFrame:
    removed = views.basket_removed(spark, sf)
    changes = membership.rebalance_changes(membership.lifecycle(views.basket(spark, sf), removed), removed)
    return membership.lifecycle_row_of_change(changes, views.intervals(spark, sf))


@query(
    "customer_lifecycles",
    "A16",
    "index_code:s cm_product_id:i member_since:s removed_at:s",
    """SELECT index_code, cm_product_id, min(effective_date) AS member_since,
    CASE WHEN max(effective_date) < DATE '2001-08-01' THEN CAST(max(effective_date) + INTERVAL 1 MONTH AS DATE) END AS removed_at
    FROM (SELECT *, date_diff('month', DATE '1990-01-01', effective_date) - row_number() OVER (PARTITION BY index_code, cm_product_id ORDER BY effective_date) AS island
          FROM (SELECT DISTINCT o_orderpriority AS index_code, o_custkey AS cm_product_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date FROM orders)) GROUP BY index_code, cm_product_id, island""",
)
def customer_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    # Every customer of a priority as a member in the months it orders in.
    months = (
        views.table(spark, sf, "orders")
        .select(
            F.col("o_orderpriority").alias("index_code"),
            F.trunc("o_orderdate", "MM").alias("effective_date"),
            F.col("o_custkey").alias("cm_product_id"),
            F.lit("all").alias("variant_key"),
        )
        .distinct()
    )
    after = F.add_months("effective_date", 1)
    keys = ["index_code", "effective_date", "cm_product_id", "variant_key"]
    gone = (
        months.withColumn("effective_date", after)
        .filter(F.col("effective_date") <= F.lit(date(2001, 8, 1)))
        .join(months, keys, "left_anti")
        .withColumn("action", F.lit("removed"))
        .withColumn("reason", F.lit("no order"))
    )
    listed = months.select(
        *keys,
        F.lit("added").alias("action"),
        F.lit("ordered").alias("reason"),
        F.lit(0.0).alias("liquidity_score"),
        F.lit(0.0).alias("ref_price"),
    )
    return membership.lifecycle(listed, gone)
