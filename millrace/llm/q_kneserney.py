"""op4: perplexity of every document under its language's trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.kneserney import judge, train


def op4_kneserney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    judged = judge(docs, model)
    model.drop()
    return judged
