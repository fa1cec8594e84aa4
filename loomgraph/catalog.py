"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import content, planted, planted_files, planted_graphs
from .plans import queries as plans

#: These fill the tables of queries.
MODULES = (content, planted_files, planted_graphs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.QUERIES | planted.QUERIES


def oracle_sql() -> dict[str, str]:
    return plans.SQL | planted.SQL
