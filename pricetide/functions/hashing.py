"""Content fingerprints that do not depend on row order or file layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_sha(body: Column) -> Column:
    return F.sha2(body, 256)


def row_sum(*cols: Column) -> Column:
    """Order-free aggregate: sum of the row hashes, exact in 38 digits."""
    return F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))


def fingerprint(*cols: Column) -> Column:
    """Aggregate expression: hash over the row count and the sum of row hashes."""
    total = F.coalesce(row_sum(*cols), F.lit(0).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total.cast("string")), 256)


def table_fingerprint(df: DataFrame) -> Column:
    """Fingerprint over all columns of `df`, in name order."""
    return fingerprint(*[F.to_json(F.struct(*sorted(df.columns)))])
