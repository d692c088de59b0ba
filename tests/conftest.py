from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from pricetide.params import IndexDefinition, Methodology  # noqa: E402
from pricetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture
def one_index() -> Methodology:
    """One singles index without seasoning, used by the small cases."""
    return Methodology(
        seasoning_days=0,
        min_price_eur={"singles": 2.0, "sealed": 10.0},
        indexes=(IndexDefinition("TEST5", "Test 5", "onepiece", "singles", 5, date(2026, 7, 1)),),
    )


def rows(df, *columns: str) -> list[tuple]:
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
