"""op5: vectors with cosine 0.9 or more, linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.crosspolytope import near_duplicates


def op5_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


SQL = """
with recursive v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
), links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
    select vec_id, vec_id as seen from v
    union
    select r.vec_id, l.b from reach r join links l on r.seen = l.a
), pieces as (
    select vec_id, min(seen) as component_id from reach group by vec_id
)
select p.vec_id, (select count(*) from links where a = p.vec_id)::bigint as n_links, p.component_id, p.vec_id = p.component_id as kept from pieces p
"""
