"""Typed tables: Parquet files, whose columns have known kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
