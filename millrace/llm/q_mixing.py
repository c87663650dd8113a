"""op2: all documents mixed to 150% of their words, sources weighing 3, 1, 2 in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.mixing import mix


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, weights=[3, 1, 2], ratio=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with sized as (
    select doc_id, source,
           coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5(concat_ws(':', '17', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) as key
    from documents
), totals as (
    select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
    select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last)) - 1) % 3 + 1]::double as w,
           source_size * 2.0::double as cap, (sum(source_size) over ())::bigint * 1.5::double as goal
    from totals
), levels as (
    select *, (goal - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
    from ranked window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), held as (
    select *, min(case when level <= cap / w then {'a': cap / w, 'l': level} end) over () as h from levels
), goals as (
    select source, source_size, case when h is null then cap else least(cap, h.l * w) end as target from held
), runs as (
    select s.doc_id, s.size, g.source_size, g.target, round(g.target)::bigint as budget,
           (sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and current row))::bigint as run
    from sized s join goals g on s.source is not distinct from g.source
), epochs as (
    select *, case when source_size > 0 then budget // source_size else 0 end as e from runs
)
select doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, budget - e * source_size - (run - size))))::bigint as taken
from epochs
"""
