"""Methodology parameters and index definitions (plain driver-side values)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetide.schemas import DEFINITION

# Language scope marker, rank/selection defaults and the price
# suffix under which each game publishes its second finish.
ALL_LANGUAGES = "ALL_CARDMARKET_EUROPE"
LANGUAGE_RESOLVED = "resolved_all_cardmarket_europe_languages"
LANGUAGE_PENDING = "pending_source_field"
HOLO_GAMES = ("pokemon",)
SOURCE_KINDS = ("priceguide", "catalogue")


@dataclass(frozen=True)
class IndexDefinition:
    code: str
    name: str
    game_key: str
    universe: str
    target_size: int
    base_date: date
    base_value: float = 1000.0
    status: str = "accumulating"
    language_scope: tuple[str, ...] = (ALL_LANGUAGES,)

    def __post_init__(self) -> None:
        if self.universe not in ("singles", "sealed"):
            raise ValueError(f"{self.code}: unknown universe {self.universe!r}")
        if self.target_size <= 0:
            raise ValueError(f"{self.code}: target_size must be positive")

    @property
    def product_kind(self) -> str:
        return "sealed" if self.universe == "sealed" else "single"

    @property
    def language_scope_status(self) -> str:
        return LANGUAGE_RESOLVED if self.language_scope == (ALL_LANGUAGES,) else LANGUAGE_PENDING

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> IndexDefinition:
        base = raw["base_date"]
        return cls(
            code=str(raw["code"]),
            name=str(raw["name"]),
            game_key=str(raw["game_key"]),
            universe=str(raw["universe"]),
            target_size=int(raw["target_size"]),
            base_date=base if isinstance(base, date) else date.fromisoformat(str(base)),
            base_value=float(raw.get("base_value", 1000)),
            status=str(raw.get("status", "accumulating")),
            language_scope=tuple(raw.get("language_scope", ())),
        )


@dataclass(frozen=True)
class Methodology:
    """Rule parameters; the defaults are the values of rule set 1.3.0."""

    methodology_version: str = "1.3.0"
    price_field_primary: str = "price_avg"
    price_field_fallback: str = "price_low"
    min_price_eur: dict[str, float] = field(
        default_factory=lambda: {"singles": 2.0, "sealed": 10.0}
    )
    seasoning_days: int = 90
    min_history_days: int = 60
    min_observation_ratio: float = 0.80
    price_floor_observation_ratio: float = 0.80
    max_suspect_zero_ratio: float = 0.05
    daily_return_cap: float = 0.25
    carry_forward_max_days: int = 5
    selection_lookback_days: int = 60
    buffer_retention_multiplier: float = 1.20
    buffer_entry_multiplier: float = 0.90
    indexes: tuple[IndexDefinition, ...] = ()

    @classmethod
    def load(cls, path: str | Path) -> Methodology:
        """Read a JSON or (when PyYAML is present) YAML parameter file."""
        text = Path(path).read_text()
        if str(path).endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as exc:
                raise RuntimeError("reading YAML parameters needs PyYAML; use JSON") from exc
            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        return cls.parse(raw)

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> Methodology:
        """Coerce a parsed parameter file; every rule value must be present."""
        version = str(raw["methodology_version"])
        reals = {
            name: float(raw[name])
            for name in (
                "min_observation_ratio",
                "price_floor_observation_ratio",
                "max_suspect_zero_ratio",
                "daily_return_cap",
                "buffer_retention_multiplier",
                "buffer_entry_multiplier",
            )
        }
        whole = {
            name: int(raw[name])
            for name in (
                "seasoning_days",
                "min_history_days",
                "carry_forward_max_days",
                "selection_lookback_days",
            )
        }
        return cls(
            methodology_version=version,
            price_field_primary=str(raw["price_field_primary"]),
            price_field_fallback=str(raw["price_field_fallback"]),
            min_price_eur={k: float(v) for k, v in raw["min_price_eur"].items()},
            indexes=tuple(IndexDefinition.parse(item) for item in raw["indexes"]),
            **reals,
            **whole,
        )

    def index_by_code(self, code: str) -> IndexDefinition:
        matches = [d for d in self.indexes if d.code == code]
        if not matches:
            raise KeyError(code)
        return matches[0]

    def enabled(self, games: list[str]) -> Methodology:
        """The same rules restricted to the definitions of some games."""
        from dataclasses import replace

        return replace(self, indexes=tuple(d for d in self.indexes if d.game_key in games))


def literal_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A parameter table as a literal relation: no job to build it, and a known tiny size."""

    def literal(value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, date):
            return f"DATE'{value.isoformat()}'"
        if isinstance(value, (list, tuple)):
            return "array(" + ", ".join(literal(v) for v in value) + ")"
        return repr(value)

    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.names)})")
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def definitions_frame(spark: SparkSession, method: Methodology) -> DataFrame:
    """Index definitions as a small dimension table (one row per index)."""
    rows = [
        (
            d.code,
            d.name,
            d.game_key,
            d.universe,
            d.product_kind,
            d.target_size,
            d.base_date,
            d.base_value,
            d.status,
            list(d.language_scope),
            d.language_scope_status,
            method.min_price_eur[d.universe],
        )
        for d in method.indexes
    ]
    return literal_table(spark, rows, DEFINITION)


def with_cutoffs(definitions: DataFrame, method: Methodology) -> DataFrame:
    """Add the retention and entry rank limits of the selection buffer."""
    n = F.col("target_size")
    return definitions.withColumn(
        "retention_cutoff", F.ceil(n * F.lit(method.buffer_retention_multiplier)).cast("int")
    ).withColumn(
        "entry_cutoff",
        F.greatest(F.lit(1), F.floor(n * F.lit(method.buffer_entry_multiplier))).cast("int"),
    )
