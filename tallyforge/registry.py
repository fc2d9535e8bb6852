"""Names of the ledger queries, their DataFrame plans and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import log_queries  # noqa: F401  registers its queries
from .queries import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry or more for each operator of the ledger library."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL."""
    return dict(ORACLE)
