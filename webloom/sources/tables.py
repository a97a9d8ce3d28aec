"""Typed scans.

``read_table`` reads one parquet table with an explicitly declared schema
(no inference, so a scan of 100 TB never samples files on the driver).
Column pruning and filter pushdown come from Catalyst; callers select the
columns they need right after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given test tables (``pages``, ``orders``, ...)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_ops_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Typed scan of one of the eight operational tables."""
    return spark.read.schema(schemas.OPS_TABLES[name]).parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses, one row per fetched URL (and engine)."""
    return spark.read.schema(schemas.RESPONSES).parquet(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SITEMAPS).parquet(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ROBOTS).parquet(path)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPLETIONS).parquet(path)
