"""All queries of the engine's own operators, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import domain, relational


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | domain.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.SQL | domain.SQL
