"""op9: bytes of documents that a repeated 200-byte string covers, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.suffixdedup import remove_repeats


def op9_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


#: Every 200-byte string by its MD5, over the hexadecimal form of the bytes; 512 starts are cut from one block, so that long texts are not walked for each.
SQL = """
with texts as (
    select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), at_blocks as (
    select r, h, unnest(range(0, length(h) // 2 - 199, 512)) as block from texts
), blocks as (
    select r, block, substr(h, 2 * block + 1, 1422) as part from at_blocks
), starts as (
    select r, block, part, unnest(range(0, least(512, length(part) // 2 - 199))) as o from blocks
), strings as (
    select r, block + o as i, md5(substr(part, 2 * o + 1, 400)) as s from starts
), repeated as (
    select r, i from strings where s in (select s from strings group by s having count(*) > 1)
), marked as (
    select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as opens from repeated
), numbered as (
    select r, i, sum(opens) over (partition by r order by i) as run from marked
), spans as (
    select r, run, min(i) as a, max(i) + 200 as b from numbered group by r, run
), gaps as (
    select r, run, a, b, coalesce(lag(b) over (partition by r order by run), 0) as since from spans
), cut as (
    select g.r, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail,
           string_agg(substr(t.h, 2 * g.since + 1, 2 * (g.a - g.since)), '' order by g.run) as kept
    from gaps g join texts t using (r) group by g.r
)
select t.doc_id, (length(t.h) // 2)::bigint as n_bytes, coalesce(c.n_removed, 0)::bigint as n_removed, coalesce(c.n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(c.kept, '') || substr(t.h, 2 * coalesce(c.tail, 0) + 1))) as kept_sha256
from texts t left join cut c using (r)
"""
