"""Nearest neighbours by vantage-point trees, one tree for each shard of the vectors.

A shard is a hash range of ids, a few thousand vectors whatever the table's
size. Its tree is built once, in one Arrow pass, and stored as a row of bytes.
A search pairs each block of queries with each shard's tree and walks the tree
for the whole block at a time. A subtree holds vectors whose distances to its
parent's vantage point lie in [lo, hi]; by the triangle inequality none of them
is nearer to the query than max(lo - d, d - hi). The subtree is skipped where
that exceeds factor * (the worst of the k nearest so far). Factor one is exact;
a smaller one skips more and may miss some.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import groups, partitions, written

SHARD_ROWS, LEAF, BLOCK = 8192, 256, 512


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim): a row for each id, its components as doubles. Null, empty, zero and non-finite vectors and null ids go; of a repeated id the least vector stays."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    plain = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return plain.filter(sound).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build(ids: np.ndarray, x: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """A tree over the rows of x, in arrays.

    Nodes lie over the order's stretches [start, end); the vantage point is
    the stretch's first row. Children split the rest at the median of the
    distances to it, by place and not by value, so ties can't make a tree deep.
    """
    order = np.argsort(ids, kind="stable")
    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []  # start, end, left, right, left lo, left hi, right lo, right hi

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, -1, 0, 0, 0, 0])
        if b - a > LEAF:
            pick = a + int(rng.integers(b - a))
            order[[a, pick]] = order[[pick, a]]
            rest = order[a + 1 : b]
            d = np.sqrt(np.square(x[rest] - x[order[a]]).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[a + 1 : b], d = rest[by], d[by]
            half = len(d) // 2
            left, right = grow(a + 1, a + 1 + half), grow(a + 1 + half, b)
            nodes[me][2:] = [left, right, d[0], d[half - 1], d[half], d[-1]]
        return me

    grow(0, len(ids))
    return {"ids": ids[order], "x": x[order], "nodes": np.array(nodes, "<f8")}


def search(tree: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids), a row of k for each query, nearest first, ties to the smaller id; inf and the largest id where there are fewer. Each query's own id is left out."""
    none = np.iinfo("<i8").max
    ids, x, nodes = tree["ids"], tree["x"], tree["nodes"]
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), none)

    lengths, q_lengths = np.square(x).sum(axis=1), np.square(q).sum(axis=1)

    def offer(rows: np.ndarray, a: int, b: int) -> None:
        # One matrix product tells, to within rounding, who can be among the nearest; only those are measured exactly.
        scale = q_lengths[rows, None] + lengths[None, a:b]
        near = scale - 2 * (q[rows] @ x[a:b].T) <= np.square(best_d[rows, -1])[:, None] + 1e-9 * scale
        near &= q_ids[rows, None] != ids[None, a:b]
        r, c = np.nonzero(near)
        if not len(r):
            return
        d = np.sqrt(np.cumsum(np.square(q[rows[r]] - x[a + c]), axis=1)[:, -1])
        hit = np.unique(r)
        row = np.concatenate([np.repeat(hit, k), r])
        d = np.concatenate([best_d[rows[hit]].ravel(), d])
        i = np.concatenate([best_i[rows[hit]].ravel(), ids[a + c]])
        order = np.lexsort((i, d, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        top = order[place < k]
        best_d[rows[hit]], best_i[rows[hit]] = d[top].reshape(-1, k), i[top].reshape(-1, k)

    def visit(node: int, rows: np.ndarray) -> None:
        a, b, left, right = (int(v) for v in nodes[node, :4])
        if left < 0:
            offer(rows, a, b)
            return
        offer(rows, a, a + 1)
        d = np.sqrt(np.square(q[rows] - x[a]).sum(axis=1))
        near_left = d <= nodes[node, 5]
        bounds = {left: nodes[node, 4:6], right: nodes[node, 6:8]}
        for child, group in ((left, near_left), (right, ~near_left), (right, near_left), (left, ~near_left)):
            lo, hi = bounds[child]
            least = np.maximum(lo - d[group], d[group] - hi)
            # A hair of slack, so that rounding never skips a tie.
            go = least <= factor * best_d[rows[group], -1] + 1e-9 * (1 + hi)
            if go.any():
                visit(child, rows[group][go])

    if len(ids) and len(q):
        visit(0, np.arange(len(q)))
    return best_d, best_i


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def trees(base: DataFrame, n_shards: int) -> DataFrame:
    """(dim, shard, ids, x, nodes): the index, a row for each tree, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim", "shard"]):
            dim = group["dim"][0].as_py()
            x = np.concatenate([_matrix(c, dim) for c in group["v"].chunks])
            tree = build(group["id"].to_numpy(), x)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int64()), "ids": [tree["ids"].astype("<i8").tobytes()], "x": [tree["x"].tobytes()], "nodes": [tree["nodes"].tobytes()]})

    sharded = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)))
    dealt = sharded.repartition(max(1, min(partitions(base.sparkSession), n_shards)), "dim", "shard").sortWithinPartitions("dim", "shard", "id")
    return written(dealt.mapInArrow(run, "dim int, shard bigint, ids binary, x binary, nodes binary"), "vp-trees")


def nearest(vectors: DataFrame, is_query: str, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by Euclidean distance in doubles, its own id left out.

    `is_query` is a SQL condition on the column `id`. Vectors are compared
    within a dimension. See usable() for nulls and repeats; fewer candidates
    than k give fewer rows, an empty table none. Nothing is broadcast and
    nothing is collected: query blocks go to every shard by a join on the
    shard's number, and k rows come back for each query and shard.
    """
    base = written(usable(vectors, id_col, vector_col), "vectors")
    n_shards = max(1, math.ceil(base.count() / shard_rows))
    index = trees(base, n_shards)
    n_blocks = max(1, math.ceil(base.filter(is_query).count() / BLOCK))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim", "block"]):
            dim = group["dim"][0].as_py()
            q = np.concatenate([_matrix(c, dim) for c in group["v"].chunks])
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "q_ids": [group["id"].to_numpy().astype("<i8").tobytes()], "q": [q.tobytes()]})

    blocks = base.filter(is_query).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)))
    blocks = blocks.repartition(max(1, min(partitions(base.sparkSession), n_blocks)), "dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(block, "dim int, q_ids binary, q binary")
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))))
    pairs = blocks.join(index, ["dim", "shard"]).select("dim", "q_ids", "q", "ids", "x", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: np.frombuffer(batch.column(c)[row].as_buffer(), "<i8" if "id" in c else "<f8")  # noqa: B023, E731
                dim = batch.column("dim")[row].as_py()
                tree = {"ids": get("ids"), "x": get("x").reshape(-1, dim), "nodes": get("nodes").reshape(-1, 8)}
                q_ids = get("q_ids")
                d, i = search(tree, q_ids, get("q").reshape(-1, dim), k, factor)
                found = np.isfinite(d)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids, found.sum(axis=1)), "vec_id": i[found], "score": d[found]})

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
