"""Registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import events, kernels
from .plans.events import split_hourly

QUERIES = events.QUERIES | kernels.QUERIES
ORACLE_SQL = events.ORACLE_SQL | kernels.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best split of the hourly event series with its score, z and whether it validates."""
    return split_hourly(spark, sf_dir)
