"""Text clean-up, coercion and parameter parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.dates import lenient_date


def first_present(*candidates: Column, default: Column | None = None) -> Column:
    """First non-NULL alias; 0 and blank text count as present."""
    options = list(candidates) + ([default] if default is not None else [])
    return F.coalesce(*options)


# Fixed value: white space that is stripped, the ASCII one and separators, then that of Unicode.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20"
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Text without white space of any kind around it."""
    return F.btrim(text, F.lit(BLANKS))


def label_key(label: Column) -> Column:
    """Normal form under which category labels are compared: stripped, case folded.

    Folding also takes the letters whose lower case isn't their folded form.
    """
    lower = F.lower(strip(label))
    return F.translate(F.replace(lower, F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def source_date(text: Column) -> Column:
    """Trimmed source date; blank and zero dates become NULL."""
    t = strip(text)
    return F.when((t != "") & ~t.startswith("0000-00-00"), t)


# The patterns of dates, weeks, tokens and gap messages below.
def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def is_iso_week(text: Column) -> Column:
    return text.rlike(r"^\d{4}-W\d{2}$")


def is_portfolio_token(text: Column) -> Column:
    return text.rlike(r"^[a-f0-9]{32}$")


def missing_manifest_day(error: Column) -> Column:
    """Day named by a missing-manifest error, else NULL."""
    day = F.regexp_extract(error, r"^(\d{4}-\d{2}-\d{2}): missing manifest$", 1)
    return F.when(day != "", day)


def split_list(text: Column) -> Column:
    """Comma list to array; blank items are dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")


def inception_map(text: Column) -> Column:
    """`game=YYYY-MM-DD` pairs to a map of dates; pairs without a valid date are dropped."""
    pairs = F.transform(split_list(text), lambda v: F.split(v, "=", 2))
    entries = F.transform(
        pairs, lambda p: F.struct(F.trim(F.get(p, F.lit(0))), lenient_date(F.trim(F.get(p, F.lit(1)))))
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["col2"].isNotNull()))


def positive_number(text: Column, upper: float | None = None) -> Column:
    """Strictly positive number (optionally bounded above), else NULL."""
    n = text.try_cast("double")
    ok = (n > 0) & ~F.isnan(n)
    if upper is not None:
        ok = ok & (n <= upper)
    return F.when(ok, n)


def allowed_headers(headers: Column) -> Column:
    """Keep the response headers an archive manifest may carry."""
    # Fixed values.
    names = ("etag", "last-modified", "cache-control", "content-type")
    return F.map_filter(headers, lambda k, _: k.isin(*names))
