import zlib
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.llm import sharding as S
from millrace.llm.common import scratch_path
from millrace.llm.q_sharding import op10_sharding

SF = "/root/testdata/sf0.001"


def test_query_against_its_law(spark):
    rows = op10_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert 0 <= r.shard < 24 and (r.grown_shard == r.shard or r.grown_shard == 24)
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert any(r.grown_shard == 24 for r in rows)
    assert len({(r.virtual_slot, r.balanced_shard) for r in rows}) == len({r.virtual_slot for r in rows})
    load = lambda name: Counter({s: sum(r.size for r in rows if r[name] == s) for s in range(25)})
    largest = max(Counter({v: sum(r.size for r in rows if r.virtual_slot == v) for v in {r.virtual_slot for r in rows}}).values())
    mean = sum(r.size for r in rows) / 25
    assert max(load("balanced_shard").values()) <= mean + largest < max(load("grown_shard").values()) + largest


def test_key_and_count_decide(spark):
    one = {r.id: r.shard for r in S.assign(spark.range(500), "id", S.first_map(spark, 24)).collect()}
    few = {r.id: r.shard for r in S.assign(spark.range(100, 200).repartition(3), "id", S.first_map(spark, 24)).collect()}
    assert all(one[i] == s for i, s in few.items())


def test_growing_evenly_and_versions(spark):
    path = scratch_path(spark, "maps")
    S.save_map(S.first_map(spark, 4, 64), path)
    S.save_map(S.grow(S.load_map(spark, path), 4, 64), path)
    first, second = ({r.slot: r.shard for r in S.load_map(spark, path, v).collect()} for v in (1, 2))
    assert {r.version for r in S.load_map(spark, path).collect()} == {2}
    with pytest.raises(AnalysisException):
        S.save_map(S.first_map(spark, 4, 64), path)
    assert S.load_map(spark, path, 1).count() == 64
    assert all(b in (first[s], 4) for s, b in second.items())
    assert sorted(Counter(second.values()).values()) == [12, 13, 13, 13, 13]


def test_rebalancing_moves_bytes_off_full_shards(spark):
    records = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 5000).otherwise(F.col("id") % 100).alias("size"))
    sizes = S.slot_bytes(records, "id", "size", 256)
    skewed = S.first_map(spark, 4, 256).withColumn("shard", F.when(F.col("slot") < 200, 0).otherwise(F.col("shard")).cast("int"))
    load = lambda m: [r[0] for r in m.join(sizes, "slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    before, after = load(skewed), load(S.rebalance(skewed, sizes, 4))
    one = S.rebalance(skewed.withColumn("shard", F.lit(0)), sizes, 4)
    assert one.count() == 256 and sorted(r.shard for r in one.select("shard").distinct().collect()) == [0, 1, 2, 3]
    assert sum(before) == sum(after) and max(after) < 1.1 * sum(after) / 4 < max(before)


def test_odd_rows(spark):
    rows = [(None, 8, 0)] * 50 + [(1, 9, 3)] * 40 + [(1, 9, 4)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, slot int")
    placed = S.positions(S.assign(df, "doc_id", S.first_map(spark, 5)).withColumn("vs", S.slot_of(F.col("doc_id"))), "shard", "vs", ["doc_id", "size", "slot"])
    got = placed.collect()
    assert Counter((r.doc_id, r.size, r.slot) for r in got) == Counter(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.position for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert S.assign(df.limit(0), "doc_id", S.first_map(spark, 5)).collect() == []
