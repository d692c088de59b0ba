"""Weekly index reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.dates import iso_week, iso_week_end, iso_week_start
from pricetide.operators.merge import replace_keys


def week_rows(history: DataFrame, week: str) -> DataFrame:
    """History rows of one ISO week; none is for the caller to treat as an error."""
    label = F.lit(week)
    return history.filter(F.col("value_date").between(iso_week_start(label), iso_week_end(label)))


def weekly_highlights(history: DataFrame, definitions: DataFrame) -> DataFrame:
    """One highlight per index and ISO week that has observations.

    All weeks at once: the baseline is the last value before the week (the running
    previous week end), else the first value in it.
    """
    weeks = history.groupBy("index_code", iso_week(F.col("value_date")).alias("week")).agg(
        F.min("value_date").alias("first_day"),
        F.min_by("index_value", "value_date").alias("first_value"),
        F.max_by("index_value", "value_date").alias("end_value"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("n_capped") > 0).alias("capped_days"),
        F.count_if(F.col("n_carried_forward") > 0).alias("carried_days"),
    )
    path = Window.partitionBy("index_code").orderBy("first_day")
    start = F.coalesce(F.lag("end_value").over(path), F.col("first_value"))
    names = definitions.select("index_code", "name")
    ret = F.col("end_value") / F.col("start_value") - 1
    events = F.array_compact(
        F.array(
            F.when(
                F.col("capped_days") > 0,
                F.concat(F.col("capped_days").cast("string"), F.lit(" day(s) included capped constituents.")),
            ),
            F.when(
                F.col("carried_days") > 0,
                F.concat(
                    F.col("carried_days").cast("string"),
                    F.lit(" day(s) used at least one carried-forward value."),
                ),
            ),
        )
    )
    none = F.array(F.lit("No calculation flags were recorded during the week."))
    return (
        weeks.withColumn("start_value", start)
        .join(names, "index_code")
        .withColumn("raw_return", ret)
        .select(
            "index_code",
            "week",
            F.concat(
                F.col("name"),
                F.when(F.col("raw_return") >= 0, " rose ").otherwise(" fell "),
                F.format_string("%.2f", F.abs(F.col("raw_return") * 100)),
                F.lit("%"),
            ).alias("headline"),
            F.round("raw_return", 8).alias("weekly_return"),
            "start_value",
            "end_value",
            "observations",
            "capped_days",
            "carried_days",
            F.when(F.size(events) > 0, events).otherwise(none).alias("notable_events"),
        )
    )


def weekly_reports(highlights: DataFrame) -> DataFrame:
    """One draft report per week with its highlights (one per index)."""
    return (
        highlights.groupBy("week")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "index_code", "headline", "weekly_return", "start_value", "end_value", "observations"
                    )
                )
            ).alias("highlights")
        )
        .withColumn("id", F.concat(F.col("week"), F.lit("-generated")))
        .withColumn("status", F.lit("draft"))
    )


def regeneration_conflicts(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Weeks that are published already and must not be generated again."""
    return existing.filter(F.col("status") == "published").join(drafts.select("week"), "week", "left_semi")


def replace_reports(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reports after the drafts replaced those of their weeks; published weeks are an error."""
    guarded = drafts.join(
        existing.filter(F.col("status") == "published").select("week", F.lit(True).alias("_published")),
        "week",
        "left",
    )
    message = F.concat(F.col("week"), F.lit(" is already published and cannot be regenerated"))
    checked = guarded.withColumn(
        "status",
        F.when(F.col("_published"), F.raise_error(message).cast("string")).otherwise(F.col("status")),
    ).drop("_published")
    return replace_keys(existing, checked.select(*existing.columns), ["week"])


def highlight_mismatch(highlights: DataFrame, definitions: DataFrame) -> DataFrame:
    """(week, index_code, problem) where a week's highlights differ from the configured codes.

    A week holds one highlight per index, so its codes fit one array.
    """
    codes = definitions.select("index_code").distinct()
    wanted = codes.agg(F.collect_set("index_code")).scalar()
    found = highlights.groupBy("week").agg(F.collect_set("index_code").alias("found"))
    missing = found.select(
        "week", F.explode(F.array_except(wanted, F.col("found"))).alias("index_code")
    ).withColumn("problem", F.lit("missing"))
    extra = (
        highlights.select("week", "index_code")
        .join(codes, "index_code", "left_anti")
        .select("week", "index_code", F.lit("unexpected").alias("problem"))
    )
    return missing.unionByName(extra)
