"""Category label -> product kind dimension."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from pricetide.functions.text import label_key
from pricetide.params import literal_table
from pricetide.schemas import struct

# Fixed values.
PRODUCT_KINDS = ("single", "sealed", "other")


def category_frame(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """(label, kind) rows from a {kind: [labels]} mapping, labels in normal form."""
    unknown = sorted(set(mapping) - set(PRODUCT_KINDS))
    if unknown:
        raise ValueError("unsupported product kinds: " + ", ".join(unknown))
    rows = [(str(label), kind) for kind, labels in mapping.items() for label in labels]
    frame = literal_table(spark, rows, struct("label string, kind string"))
    return frame.select(label_key(F.col("label")).alias("label"), "kind").distinct()


def load_category_map(spark: SparkSession, path: str | Path) -> DataFrame:
    """Read a JSON or YAML category file and reject labels that map to two kinds."""
    text = Path(path).read_text()
    raw: Any
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading a YAML category map needs PyYAML; use JSON") from exc
        raw = yaml.safe_load(text) or {}
    else:
        import json

        raw = json.loads(text)
    if not isinstance(raw, dict) or not all(isinstance(v, list) for v in raw.values()):
        raise ValueError("category map must be an object of label lists")
    frame = category_frame(spark, raw)
    # No more rows than the configuration file has labels.
    clashes = sorted(r.label for r in conflicting_labels(frame).collect())
    if clashes:
        raise ValueError("category labels map to two kinds: " + ", ".join(clashes))
    return frame


def conflicting_labels(categories: DataFrame) -> DataFrame:
    return (
        categories.groupBy("label")
        .agg(F.count_distinct("kind").alias("kinds"))
        .filter(F.col("kinds") > 1)
    )
