"""Registry of queries: a Spark callable each, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["sources", "parsing", "features", "alerts", "feedback", "models", "streams"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def register(fn):
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _queries[name] = fn
        if oracle is not None:
            _oracles[name] = oracle
        return fn

    return register


def registered(name: str) -> str:
    """SQL of a query registered earlier, to build on."""
    return _oracles[name]


def load() -> None:
    for module in MODULES:
        import_module(f"emberwatch.plans.{module}_queries")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    load()
    return dict(_oracles)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating-point columns so both engines print the same digits."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
