"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duotide.plans.oracle import settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with its SQL if SQL can say it."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = settle(sql)
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from duotide.plans import catalog_features, catalog_layers, catalog_models, catalog_streams  # noqa: F401

    return QUERIES, ORACLES
