"""Every operator as a query over the driver's tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, files, lookups, numbers, series, tables, text
from .base import ENTRIES

_ORDER = (aggregates, lookups, tables, series, text, numbers, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.flagship(spark, sf_dir)
