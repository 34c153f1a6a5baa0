"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, ledger, resolution, summaries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**catalog.QUERIES, **resolution.QUERIES, **ledger.QUERIES, **summaries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog.SQL, **resolution.SQL, **ledger.SQL, **summaries.SQL}
