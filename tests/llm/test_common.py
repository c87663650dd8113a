import random

import pyarrow as pa

from millrace.llm import common


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    edges += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(80)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    ends = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges + edges[:5], "a bigint, b bigint")).collect()}
    assert got == {n: label[n] for n in ends}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_chunks_hold_every_row():
    batch = pa.record_batch({"t": ["a" * n for n in (5, 0, 30, 3, 3, 3)] + [None]})
    parts = list(common.chunks(batch, 0, 8))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column(0).to_pylist()) <= 8 for p in parts)


def test_groups_cross_batches():
    batches = [pa.record_batch({"k": [1, 1, 2]}), pa.record_batch({"k": pa.array([], pa.int64())}), pa.record_batch({"k": [2, 2, 5]})]
    assert [g["k"].to_pylist() for g in common.groups(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [5]]


def test_shared_folder_is_the_sessions_own(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    table = common.written(spark.range(3).toDF("id"), "test")
    assert table.millrace_path.startswith(common.shared_dir(spark)) and table.count() == 3
    common.dropped(table)
