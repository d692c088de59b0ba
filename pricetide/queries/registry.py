"""Query registration: a Spark query, its output columns and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.queries.views import sql as compose


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    columns: str
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    views: tuple[str, ...] = ()

    @property
    def oracle(self) -> str | None:
        """The complete SQL text of the oracle."""
        if self.body is None:
            return None
        return compose(list(self.views), present_sql(self.body, self.columns))


REGISTRY: dict[str, Query] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":", 1)) for item in columns.split()]  # type: ignore[misc]


def present(df: DataFrame, columns: str) -> DataFrame:
    """Output columns in comparable types: s text, i bigint, fN double at N places, b boolean."""
    out = []
    for name, kind in _parse(columns):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), int(kind[1:]))
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(body: str, columns: str) -> str:
    """The same column conversions around a SQL body (+ 0 turns -0.0 into 0.0)."""
    out = []
    for name, kind in _parse(columns):
        if kind == "s":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "b":
            out.append(f"CAST({name} AS BOOLEAN) AS {name}")
        else:
            out.append(f"ROUND(CAST({name} AS DOUBLE), {kind[1:]}) + 0 AS {name}")
    return f"SELECT {', '.join(out)} FROM ({body}) result"


def query(
    name: str,
    covers: str,
    columns: str,
    oracle: str | None = None,
    views: list[str] | None = None,
) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query. `covers` lists the survey entries it exercises."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), columns)

        REGISTRY[name] = Query(name, tuple(covers.split()), columns, run, oracle, tuple(views or ()))
        return fn

    return add


def load() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from pricetide.queries import (  # noqa: F401
        analytics,
        archive,
        chain,
        composition,
        expressions,
        governance,
        jobs,
        normalisation,
        portfolio,
        selection,
        serving,
    )

    return REGISTRY
