import numpy as np

from millrace.llm import vptree as V


def brute(rows, is_query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if is_query(i):
            d = np.sqrt(np.cumsum(np.square(x - v), axis=1)[:, -1])  # components in order, as the operator adds them
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_factor_one_is_exact_with_ties_and_copies():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(900, 8)), 1)
    x[300:500] = x[299]  # copies: every distance ties
    rows = [(int(i), v) for i, v in zip(rng.permutation(900), x, strict=True)]
    tree = V.build(np.array([i for i, _ in rows]), x)
    q = np.arange(0, 900, 9)
    at = {i: v for i, v in rows}
    d, i = V.search(tree, q, np.array([at[j] for j in q]), 10)
    assert {int(a): b.tolist() for a, b in zip(q, i, strict=True)} == brute(rows, lambda j: j % 9 == 0, 10)
    loose = V.search(tree, q, np.array([at[j] for j in q]), 10, factor=0.5)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(i.tolist(), loose.tolist(), strict=True)]) > 0.5


def test_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6)], i) for i in range(260)]
    bad = [(1000, None, 0), (1100, [0.0] * 6, 0), (1200, [float("nan")] + [1.0] * 5, 0), (1300, [None] + [1.0] * 5, 0), (1400, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in sorted(V.nearest(df, "id % 100 = 0", shard_rows=50).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute([r[:2] for r in rows], lambda j: j % 100 == 0, 10)
    few = V.nearest(df.filter("vec_id in (0, 1, 2)"), "id % 100 = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert V.nearest(df.limit(0), "id % 100 = 0").collect() == []
