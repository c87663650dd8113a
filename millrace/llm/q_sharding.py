"""op10: documents into 24 shards by virtual slots, law `key`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import sharding as S
from millrace.llm.common import scratch_path, written

SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: doc_id and the number of shards decide; a 25th shard only takes rows.

    Null texts count no bytes and CRC 0. `slot` is a row's place in its shard;
    `virtual_slot` is its fixed slot. Bytes are added up by fixed slot, and the
    map's third version evens them out over the 25 shards: `balanced_shard`.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"))
    path = scratch_path(spark, "slot-map")
    S.save_map(S.first_map(spark, SHARDS), path)
    S.save_map(S.grow(S.load_map(spark, path, 1), SHARDS), path)
    sizes = written(S.slot_bytes(sized, "doc_id", "size"), "slot-bytes")
    S.save_map(S.rebalance(S.load_map(spark, path, 2), sizes, SHARDS + 1), path)
    sized = S.assign(sized, "doc_id", S.load_map(spark, path, 1))
    sized = S.assign(sized, "doc_id", S.load_map(spark, path, 2), name="grown_shard")
    sized = S.assign(sized, "doc_id", S.load_map(spark, path, 3), name="balanced_shard")
    sized = sized.withColumn("virtual_slot", S.slot_of(F.col("doc_id")))
    placed = S.positions(sized, "shard", "virtual_slot", ["doc_id", "size", "text_crc32", "grown_shard", "balanced_shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("position").alias("slot"), "grown_shard", "virtual_slot", "balanced_shard")


#: CRC-32 by its byte table (polynomial 3988292384, reflected); slots and cells by the leading 32 bits of MD5.
SQL = """
with bits as (
    select n, list_reduce(range(0, 9), lambda c, i: case when i = 0 then c when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) as v
    from (select unnest(range(0, 256))::bigint as n)
), crc_table as (
    select list(v order by n) as t from bits
), bytes as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), sized as (
    select doc_id, length(h) // 2 + 8 as size,
           xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 4096 as virtual_slot
    from bytes, crc_table
), slots as (
    select slot, slot % 24 as shard, row_number() over (partition by slot % 24 order by md5(slot::varchar), slot) as place
    from (select unnest(range(0, 4096)) as slot)
), grown as (
    select slot, shard::integer as shard, (case when place > ceil(4096 / 25.0) then 24 else shard end)::integer as grown_shard from slots
), held as (
    select g.slot, g.grown_shard as shard, coalesce(b.bytes, 0) as bytes, sum(coalesce(b.bytes, 0)) over () as total
    from grown g left join (select virtual_slot, sum(size) as bytes from sized group by virtual_slot) b on g.slot = b.virtual_slot
), ranked as (
    select *, sum(bytes) over (partition by shard order by bytes desc, slot rows unbounded preceding) as run,
           row_number() over (partition by shard order by bytes desc, slot) as place from held
), judged as (
    select *, place = 1 or bytes = 0 or run * 25 <= total as stays from ranked
), loads as (
    select shard, max(total) - 25 * sum(case when stays then bytes else 0 end) as gap from judged group by shard
), gaps as (
    select shard, sum(gap) over (order by shard) - gap as since, sum(gap) over (order by shard) as upto from loads where gap > 0
), movers as (
    select slot, (2 * sum(bytes) over (order by bytes desc, slot rows unbounded preceding) - bytes) * 25 as middle from judged where not stays
), moved as (
    select m.slot, g.shard from movers m join gaps g on m.middle >= 2 * g.since and m.middle < 2 * g.upto
), mapped as (
    select s.*, g.shard, g.grown_shard, coalesce(v.shard, g.grown_shard) as balanced_shard
    from sized s join grown g on s.virtual_slot = g.slot left join moved v on s.virtual_slot = v.slot
), celled as (
    select *, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::varchar, ''), size, text_crc32, grown_shard, balanced_shard)), 1, 8))::bigint % 16 as cell from mapped
)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by virtual_slot, cell, doc_id, size, text_crc32, grown_shard, balanced_shard) - 1 as slot, grown_shard, virtual_slot, balanced_shard
from celled
"""
