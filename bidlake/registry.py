"""All queries of the library but those of the optional subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, records, streams  # noqa: F401  both add their queries to the catalogue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalog.queries()


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
