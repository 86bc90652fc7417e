"""Every query of the library by its operator id, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import built, mentions, more, questions, search, wider
from tessera.plans.catalog import CATALOG, flagship

__all__ = ["built", "flagship", "mentions", "more", "oracle_sql", "queries", "questions", "search", "wider"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
