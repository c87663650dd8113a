"""op6: near-duplicate documents, five words, edit similarity 0.8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.orderminhash import near_duplicates


def op6_orderminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
