"""op1: every document encoded and decoded with the 32k merge vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.sentencepiece_bpe import tokenize

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenize(docs, model_path(), digest=True)
