"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def next_month(d: Column) -> Column:
    """First day of the month after the one holding `d`."""
    return F.add_months(month_start(d), 1)


def month_start_on_or_after(d: Column) -> Column:
    return F.when(F.dayofmonth(d) == 1, d).otherwise(next_month(d))


def iso_week(d: Column) -> Column:
    """ISO week label such as 2026-W31."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def iso_week_start(label: Column) -> Column:
    """Monday of an ISO week label; NULL when the label is malformed or out of range."""
    year = F.regexp_extract(label, r"^(\d{4})-W(\d{2})$", 1)
    week = F.regexp_extract(label, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    anchor = F.concat(year, F.lit("-01-04")).try_cast("date")
    first_monday = F.date_trunc("week", anchor).cast("date")
    return F.when(week.between(1, 53), F.date_add(first_monday, (week - 1) * 7))


def iso_week_end(label: Column) -> Column:
    return F.date_add(iso_week_start(label), 6)


def month_starts_seen_from(d: Column, lookback_days: int) -> Column:
    """Month starts whose look-back window [start - L, start) holds the day `d`."""
    first = next_month(d)
    last = month_start(F.date_add(d, lookback_days))
    return F.when(
        first <= last, F.sequence(first, last, F.expr("interval 1 month"))
    ).otherwise(F.array().cast("array<date>"))


def inclusive_days(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 day"))


def lenient_date(text: Column) -> Column:
    """Date of the first ten characters; NULL when they are no ISO date."""
    head = F.substring(text.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def freshness_age(latest: Column, today: Column) -> Column:
    parsed = lenient_date(latest)
    return F.when(parsed <= today, F.datediff(today, parsed))


def freshness_level(latest: Column, today: Column) -> Column:
    age = freshness_age(latest, today)
    return (
        F.when(age.isNull(), "unknown")
        .when(age <= 2, "fresh")
        .when(age <= 7, "delayed")
        .otherwise("stale")
    )


def freshness_label(latest: Column, today: Column) -> Column:
    age = freshness_age(latest, today)
    return (
        F.when(lenient_date(latest).isNull(), "Freshness unknown")
        .when(age.isNull(), "Future-dated snapshot")
        .when(age == 0, "Current today")
        .when(age == 1, "1 day old")
        .otherwise(F.concat(age.cast("string"), F.lit(" days old")))
    )
