"""op8: each hundredth vector's ten nearest, by exact vantage-point search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.vptree import nearest


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 100 = 0", k=10, factor=1.0)


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
), scored as (
    select q.vec_id as query_id, c.vec_id,
           sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select *, (row_number() over (partition by query_id order by score, vec_id))::integer as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
