"""Registered queries over the driver tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import intervals, movement, network, patterns, profiles, series, stats, tables  # noqa: F401
from .bindings import Tables
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flagship(Tables(spark, sf_dir))
