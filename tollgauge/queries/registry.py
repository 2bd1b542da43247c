"""Query registry: each entry is a DataFrame builder over ``Views`` and, where possible, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollgauge.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder ``Views -> DataFrame`` under ``name``."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
