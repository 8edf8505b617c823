"""Readers of the Parquet tables in a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; any store that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
