"""The registered queries: every operator over the sample tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from creditloom.queries import features, models, relational, sources, validation

    out: dict[str, Query] = {}
    for module in (sources, relational, features, validation, models):
        out |= module.QUERIES
    return out


def all_oracles() -> dict[str, str]:
    from creditloom.oracle import features, models, relational, sources, validation

    out: dict[str, str] = {}
    for module in (sources, relational, features, validation, models):
        out |= module.oracles()
    return out
