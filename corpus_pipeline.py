"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written
and read again as the next stage's docs. All but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import kneserney, mixing, orderminhash, pii
from millrace.llm.common import fresh, set_aside, small, written
from millrace.llm.q_sentencepiece import model_path
from millrace.llm.sentencepiece_bpe import tokenize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of their language keeps; it learns from the trusted labels among docs.

    Null text counts as empty; a null language is one of its own, and a language
    without a threshold keeps all. Very long texts are judged whole; a document
    at the threshold stays; equal rows share a verdict. Extra columns are
    carried, whatever their names. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = kneserney.train(docs, labels)
    kept = kneserney.accepted(docs, model)
    model.drop()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: that with the least doc_id, null last; of equal ids, any.

    Rows are told apart by a number of their own, so repeated rows and rows that
    share an id, or have none, go by their text as others do. Null text is like
    no other: such rows stay. Empty texts are alike. Very long texts are
    compared whole. Extra columns are carried, whatever their names. An empty
    table stays empty.
    """
    row = fresh("row", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = orderminhash.near_duplicates(numbered.select(row, "text"), id_col=row).select(F.col("doc_id").alias("member"), "class_id")
    classes = written(classes.join(numbered.select(F.col(row).alias("member"), "doc_id"), "member"), "row-classes")
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "member")).alias("first")).select(F.col("first.member").alias("member"))
    gone = written(classes.select("member").join(first, "member", "left_anti").select(F.col("member").alias(fresh("gone", numbered.columns))), "duplicates")
    return numbered.join(small(gone), F.col(row) == F.col(gone.columns[0]), "left_anti").select(*[numbered[c] for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the new text.

    Null text stays null, with a null n_chars; empty and very long texts, ties of
    spans and repeats as in pii.find. Extra columns are carried, whatever their
    names. An empty table stays empty.
    """
    apart, rest, restored = set_aside(docs, "text", "n_chars")
    found = pii.find(apart, id_col=rest[0], keep=rest)
    return restored(found.withColumn("text", F.col("masked")).withColumn("n_chars", F.length("masked").cast("bigint")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, 3 : 1 : 2 in turn, of 150% of the words: a row each time a document is taken.

    Documents without words, null text included, are never drawn. A null source
    is one of its own, last. Ties of keys are broken by id and size; repeated
    rows are documents of their own. Very long texts are drawn whole, or to
    their last missing word. Extra columns are carried, whatever their names.
    An empty table stays empty.
    """
    apart, rest, restored = set_aside(docs, "doc_id", "text", "source", "n_chars")
    mixed = mixing.mix(apart, keep=["text", *rest])
    return restored(mixing.drawn(mixed).withColumn("n_chars", F.length("text").cast("bigint")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and hashes of each drawn document's ids and decoded text, a row for each row.

    Null and empty texts have begin and end only. Very long texts are encoded
    whole. Extra columns are not read. An empty table gives no rows.
    """
    return tokenize(docs, model_path(), digest=True)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("PII", personal_data), ("mixing sources", mixture), ("SentencePiece", tokens)]

#: No SQL form: the model, the sketches and the field of stages 1 to 3 are not expressible; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage-{at}")
    return docs
