"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A flat schema from `name type, name type`; unlike DDL parsing it needs no session."""
    fields = [item.strip().split(" ", 1) for item in columns.replace("string,string", "string;string").split(",")]
    return T.StructType(
        [T.StructField(name, _TYPES[kind.strip().replace(";", ",")]) for name, kind in fields]
    )


DEFINITION = struct(
    "index_code string, name string, game_key string, universe string, product_kind string,"
    " target_size int, base_date date, base_value double, status string,"
    " language_scope array<string>, language_scope_status string, min_price double"
)

MANIFEST_FILE = struct(
    "game string, kind string, key string, sha256_uncompressed string, size_uncompressed bigint,"
    " fetched_at string, headers map<string,string>, source_created_at string,"
    " unchanged_from_previous boolean"
)
MANIFEST = T.StructType(
    [
        T.StructField("run_date", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("files", T.ArrayType(MANIFEST_FILE)),
        T.StructField("_corrupt", T.StringType()),
    ]
)

PRODUCTS = struct(
    "stable_product_id string, game_key string, cm_product_id bigint, cm_metacard_id bigint,"
    " cm_category_id bigint, cm_expansion_id bigint, name string, product_kind string,"
    " raw_category string, source_date_added string, first_seen date, last_seen date"
)
SETS = struct(
    "stable_set_id string, game_key string, cm_expansion_id bigint, name string,"
    " release_date string, first_seen date, last_seen date"
)
VARIANTS = struct(
    "stable_variant_id string, stable_product_id string, game_key string, cm_product_id bigint,"
    " variant_key string, product_kind string, first_seen date, last_seen date"
)
PRICES = struct(
    "stable_variant_id string, stable_product_id string, game_key string, cm_product_id bigint,"
    " cm_category_id bigint, product_kind string, value_date date, variant_key string,"
    " price_low double, price_avg double, avg1 double, avg7 double, avg30 double"
)

# As stored: partitioned by game_key and month (yyyy-MM).
PRICE_TABLE = T.StructType([*PRICES.fields, T.StructField("month", T.StringType())])

# As stored: partitioned by game_key, month and what the month's summaries were made from.
LIQUIDITY_SUMMARY = struct(
    "game_key string, product_kind string, stable_variant_id string, cm_product_id bigint,"
    " variant_key string, segment date, min_price double, primary_days bigint, floor_days bigint,"
    " zero_days bigint, changes bigint, dispersion_sum double, dispersion_days bigint,"
    " used_sum double, used_days bigint, first_date date, last_date date, first_avg double,"
    " last_avg double, avg30 double, avg30_date date, month string, source string"
)

REBALANCE = struct(
    "index_code string, effective_date date, methodology_version string,"
    " snapshot_sha256 string, eligible_count bigint"
)
MEMBER = struct(
    "index_code string, effective_date date, cm_product_id bigint, variant_key string,"
    " stable_variant_id string, action string, reason string, liquidity_score double,"
    " ref_price double, rank int"
)
DAILY_VALUES = struct(
    "index_code string, value_date date, index_value double, daily_return double,"
    " n_constituents_active bigint, n_capped bigint, n_carried_forward bigint, n_stale bigint,"
    " whole_market_carried_forward boolean, rebalance_effective_date date, calc_version string"
)
CONTRIBUTIONS = struct(
    "index_code string, value_date date, stable_variant_id string, cm_product_id bigint,"
    " variant_key string, weight double, used_return double, contribution double, flag string"
)
INTERVALS = struct(
    "index_code string, cm_product_id bigint, variant_key string, name string, set_name string,"
    " member_since date, removed_at date, action string, entry_reason string,"
    " removal_reason string, liquidity_score double, ref_price double"
)
HISTORY = struct(
    "index_code string, value_date date, index_value double, daily_return double,"
    " n_constituents_active int, n_capped int, n_carried_forward int, calc_version string"
)
QUALITY = struct(
    "index_code string, run_date date, status string, available_archive_days bigint,"
    " required_lookback_days int, target_size int, selected_constituents bigint,"
    " language_scope_status string"
)
CALC_RECEIPT = struct(
    "index_code string, run_date date, status string, available_days bigint, required_days int,"
    " selected_constituents bigint"
)
HOLDING = struct(
    "portfolio_id bigint, line int, cm_product_id bigint, variant_key string, quantity double,"
    " cost_basis_eur double"
)
RECEIPT = struct("output string, rows bigint, fingerprint string, changed boolean")
