"""Parquet tables by name; every path goes to Spark's readers unopened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a data folder on any store that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
