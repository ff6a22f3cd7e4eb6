"""Parquet sources: datasets (cubes) and the provided relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columnar scan; filters and projections applied later reach the reader
    (PushedFilters / ReadSchema). Every column is kept."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables, listed anew at each call."""
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
