"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated at random (three rounds of random signs and a fast Hadamard
transform) and hashed to the nearest of the 2d signed axes; `axes` such hashes
name its bucket in a table. Multiprobe: a vector also looks into the buckets
that lie next nearest. Only pairs at the threshold or above count, in doubles.

What travels to the buckets is a draft: a byte for each component, the step
between bytes, and the exact distance from the vector. The drafts of two
vectors bound their cosine from both sides, which decides most pairs. Vectors
with an undecided pair in a bucket go there once more, as doubles, to settle
those pairs. Drafts are hashed too, so every task finds the same buckets.

No pairs leave a bucket. A bucket gives each vector's number of links and a
star for each connected piece, so its output is as long as the bucket. A pair
that meets in several buckets is counted in the first one only: both vectors'
hashes in the earlier tables tell whether they met there. Buckets above TILE
rows are cut into tiles of their own tasks, which together compare all of the
bucket; there is no cap.

The number of axes follows the number of vectors, so buckets stay as long at
any size. At the cosine of 0.9 one table finds a pair with probability 0.76,
0.61 or 0.48 for one, two or three axes (64 dimensions); TABLES makes that
above 0.9997 in all, and more for closer pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, groups, partitions, written
from millrace.llm.vptree import usable

#: By number of axes: tables, and buckets that a vector looks into beside its own.
TABLES = {1: (6, 1), 2: (10, 3), 3: (14, 7)}
TILE = 1024
#: Vectors for each bucket that the number of axes aims at, at most.
BUCKET_ROWS = 600
#: Oversized buckets up to this number are broadcast (under 1 MB); more are joined by a shuffle.
BROADCAST_BUCKETS = 10_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hash:
    """The bucket numbers of vectors; the signs come from a seed, so every task has the same."""

    def __init__(self, dim: int, axes: int, tables: int, probes: int, seed: int = 11):
        self.dim, self.width, self.axes, self.tables, self.probes = dim, 1 << max(0, dim - 1).bit_length(), axes, tables, probes
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, axes, 3, self.width))
        self.nearest = min(probes + 1, 2 * self.width, 4)
        combos = list(itertools.product(range(self.nearest), repeat=axes))
        self.combos = np.array(sorted(combos, key=sum)[: 4 * (probes + 1)])

    def __call__(self, x: np.ndarray, table: int) -> np.ndarray:
        """A row for each vector: its own bucket, then the buckets that it looks into, nearest first."""
        padded = np.zeros((len(x), self.width))
        padded[:, : self.dim] = x
        own, lost = [], []
        for k in range(self.axes):
            y = padded
            for signs in self.signs[table, k]:
                y = hadamard(y * signs)
            y = np.concatenate([y, -y], axis=1)
            top = np.argsort(-y, axis=1, kind="stable")[:, : self.nearest]
            values = np.take_along_axis(y, top, 1)
            own.append(top)
            lost.append(np.square(values[:, :1] - values))
        cost = sum(lost[k][:, self.combos[:, k]] for k in range(self.axes))
        chosen = np.argsort(cost, axis=1, kind="stable")[:, : self.probes + 1]
        code = np.zeros(chosen.shape, "<i8")
        for k in range(self.axes):
            code = code * (2 * self.width) + np.take_along_axis(own[k], self.combos[:, k][chosen], 1)
        return code


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether vectors with these bucket rows meet in the table: one's own bucket is among the other's."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def drafts(u: np.ndarray) -> list[bytes]:
    """Step and error (floats), then a byte for each component, of unit vectors; the error is rounded up."""
    step = (np.abs(u).max(axis=1) / 127).astype("<f4")
    whole = np.clip(np.rint(u / step[:, None].astype(float)), -127, 127)
    error = np.sqrt(np.square(u - step[:, None].astype(float) * whole).sum(axis=1))
    heads = np.stack([step, np.nextafter(error.astype("<f4"), np.float32(np.inf))], axis=1).astype("<f4")
    return [h.tobytes() + c.tobytes() for h, c in zip(heads, whole.astype("i1"), strict=True)]


class Drafts:
    """Drafts read back: whole components as doubles, steps and errors."""

    def __init__(self, raw: list[bytes], dim: int):
        data = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, dim + 8)
        heads = np.ascontiguousarray(data[:, :8]).view("<f4").astype(float)
        self.whole, self.step, self.error = np.ascontiguousarray(data[:, 8:]).view("i1").astype(float), heads[:, 0], heads[:, 1]

    def rows(self, at: np.ndarray) -> Drafts:
        out = object.__new__(Drafts)
        out.whole, out.step, out.error = self.whole[at], self.step[at], self.error[at]
        return out

    def vectors(self) -> np.ndarray:
        return self.whole * self.step[:, None]


#: Room for rounding where drafts decide; pairs this near are settled by doubles.
ROUNDING = 1e-9


def tile_links(hashed: Hash, table: int, stored: tuple, looking: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, decided) of a tile: pairs at the threshold, or not ruled out, that are counted here.

    stored and looking: (ids, Drafts, looks from its own bucket). The products
    are whole numbers, so a pair gets the same bounds in any company.
    """
    s_ids, s_d, _ = stored
    q_ids, q_d, q_own = looking
    cosine = (q_d.whole @ s_d.whole.T) * (q_d.step[:, None] * s_d.step)
    off = q_d.error[:, None] + s_d.error + 3 * q_d.error[:, None] * s_d.error + ROUNDING
    q, s = np.nonzero(cosine + off >= threshold)
    # Two vectors of one bucket see each other twice.
    keep = (q_ids[q] != s_ids[s]) & (~q_own[q] | (q_ids[q] < s_ids[s]))
    q, s = q[keep], s[keep]
    decided = (cosine - off)[q, s] >= threshold
    if not len(q):
        return q, s, decided
    rows_q, q_at = np.unique(q, return_inverse=True)
    rows_s, s_at = np.unique(s, return_inverse=True)
    x_q, x_s = q_d.rows(rows_q).vectors(), s_d.rows(rows_s).vectors()
    fresh = np.ones(len(q), bool)
    for t in range(table + 1):
        cq, cs = hashed(x_q, t), hashed(x_s, t)
        for at in range(0, len(q), 1 << 18):
            part = slice(at, at + (1 << 18))
            a, b = cq[q_at[part]], cs[s_at[part]]
            if t < table:
                fresh[part] &= ~met(a, b)
            else:
                # In this table both may look into the other's bucket; the smaller id's bucket counts.
                back = (a[:, :1] == b).any(axis=1) & ~q_own[q[part]]
                fresh[part] &= ~(back & (q_ids[q[part]] < s_ids[s[part]]))
    return q[fresh], s[fresh], decided[fresh]


def settled(x_q: np.ndarray, x_s: np.ndarray, q: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of positions have the cosine, by the unit vectors in doubles."""
    out = np.zeros(len(q), bool)
    for at in range(0, len(q), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = np.einsum("ij,ij->i", x_q[q[part]], x_s[s[part]]) >= threshold
    return out


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its piece) for the pieces that pairs of positions (a, b) make."""
    nodes, inverse = np.unique(ids, return_inverse=True)
    a, b = inverse[a], inverse[b]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", axes: int | None = None, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each id.

    Null, zero and non-finite vectors link with nothing and stay. A repeated id
    counts once, with its least vector. A null id gets a row with no links, a
    null component and kept false. Vectors are compared within a dimension.
    Equal vectors, by 128 bits of hash, are one class with a count from the
    start, so copies cost one row however many they are. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    sound = written(usable(vectors, id_col, vector_col).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}), "vectors")
    distinct = sound.groupBy("dim", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.min("v").alias("v"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                u = unit(part.column("v").flatten().to_numpy().reshape(-1, int(dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(drafts(u), pa.binary())], [*part.schema.names, "draft"])

    classes = written(distinct.mapInArrow(draw, "dim int, k1 bigint, k2 bigint, rep bigint, w bigint, v array<double>, draft binary"), "classes")
    n = classes.count()
    axes = axes or min(3, max(1, math.ceil(math.log(max(1.0, n / BUCKET_ROWS)) / math.log(128))))
    tables, probes = TABLES[axes]

    def hash_rows(with_drafts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Hash] = {}
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    hashed = made.setdefault(int(dim), Hash(int(dim), axes, tables, probes))
                    part = batch.filter(pa.array(dims == dim))
                    x = Drafts(part.column("draft").to_pylist(), int(dim)).vectors()
                    for t in range(tables):
                        codes = hashed(x, t)
                        for p in range(codes.shape[1]):
                            columns = {"dim": part.column("dim"), "t": np.full(len(x), t, "<i4"), "bucket": codes[:, p], "own": np.full(len(x), p == 0), "id": part.column("rep")}
                            yield pa.RecordBatch.from_pydict(columns | ({"w": part.column("w"), "draft": part.column("draft")} if with_drafts else {}))

        return run

    key = "dim int, t int, bucket bigint, own boolean, id bigint"
    source = classes.select("dim", "rep", "w", "draft").repartition(partitions(spark))
    counts = source.mapInArrow(hash_rows(False), key).groupBy("dim", "t", "bucket").agg(F.sum(F.col("own").cast("int")).alias("s"), F.count("*").alias("q"))
    big = written(counts.filter(F.col("q") > tile).select("dim", "t", "bucket", F.ceil(F.col("s") / tile).cast("int").alias("cs"), F.ceil(F.col("q") / tile).cast("int").alias("cq")), "big-buckets")
    rows = source.mapInArrow(hash_rows(True), key + ", w bigint, draft binary")
    rows = rows.join(F.broadcast(big) if big.count() <= BROADCAST_BUCKETS else big, ["dim", "t", "bucket"], "left")
    cs, cq = F.greatest(F.col("cs"), F.lit(1)), F.greatest(F.col("cq"), F.lit(1))
    at = lambda role, i, j: F.struct(F.lit(role).alias("role"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    i, j = F.pmod(F.xxhash64("id"), cs), F.pmod(F.xxhash64("id"), cq)
    as_stored = F.transform(F.sequence(F.lit(0), cq - 1), lambda x: at("s", i, x))
    as_looking = F.transform(F.sequence(F.lit(0), cs - 1), lambda x: at("q", x, j))
    tiles = F.when(F.col("cq").isNull(), F.array(F.when(F.col("own"), at("b", F.lit(0), F.lit(0))).otherwise(at("q", F.lit(0), F.lit(0))))).when(F.col("own"), F.concat(as_stored, as_looking)).otherwise(as_looking)
    tiled = rows.select("dim", "t", "bucket", "own", "id", "w", "draft", F.explode(tiles).alias("at")).select("dim", "t", "bucket", "own", "id", "w", "draft", "at.*")
    keys = ["dim", "t", "bucket", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links and stars of each tile; without vectors, also the rows that hold an undecided pair."""
        made: dict[int, Hash] = {}
        for group in groups(batches, keys):
            if group.num_rows < 2:
                continue
            dim = group["dim"][0].as_py()
            hashed = made.setdefault(dim, Hash(dim, axes, tables, probes))
            whole = Drafts(group["draft"].to_pylist(), dim)
            ids, w, own = group["id"].to_numpy(), group["w"].to_numpy(), group["own"].to_numpy()
            role = group["role"].to_numpy()
            s, q = np.flatnonzero(role != "q"), np.flatnonzero(role != "s")
            if not len(s) or not len(q):
                continue
            a, b, decided = tile_links(hashed, group["t"][0].as_py(), (ids[s], whole.rows(s), own[s]), (ids[q], whole.rows(q), own[q]), threshold)
            a, b = q[a], s[b]
            if "v" in group.column_names:
                x = unit(group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
                a, b = a[~decided], b[~decided]
                near = settled(x, x, a, b, threshold)
                a, b = a[near], b[near]
            elif len(a):
                open_rows = np.unique(np.concatenate([a[~decided], b[~decided]]))
                if len(open_rows):
                    yield shaped(group.select([*keys, "role", "own", "id"]).take(open_rows), len(open_rows))
                a, b = a[decided], b[decided]
            if len(a):
                n_links = np.bincount(a, w[b], len(ids)) + np.bincount(b, w[a], len(ids))
                linked = np.flatnonzero(n_links)
                node, root = stars(ids, a, b)
                yield shaped({"id": ids[linked], "n": n_links[linked].astype("<i8")}, len(linked))
                yield shaped({"id": node, "root": root}, len(node))

    found_columns = pa.schema([("dim", pa.int32()), ("t", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.string()), ("own", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def shaped(columns: pa.Table | dict, n: int) -> pa.RecordBatch:
        """The columns, with nulls for the rest: links have n, edges a root, undecided rows a role."""
        have = {c: columns[c].combine_chunks() for c in columns.column_names} if isinstance(columns, pa.Table) else columns
        return pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(n, f.type) for f in found_columns], schema=found_columns)

    def compared(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
        return written(dealt.mapInArrow(compare, "dim int, t int, bucket bigint, i int, j int, role string, own boolean, id bigint, n bigint, root bigint"), name)

    first = compared(tiled, "links")
    undecided = first.filter("role is not null").select(*keys, "role", "own", "id")
    second = compared(undecided.join(classes.select(F.col("rep").alias("id"), "w", "v", "draft"), "id"), "settled-links")
    found = first.union(second)
    links = found.filter("n is not null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    reached = components(found.filter("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    result = classes.select("dim", "k1", "k2", "rep", "w").join(links, "rep", "left").join(reached, "rep", "left")
    result = sound.select("id", "dim", "k1", "k2").join(result, ["dim", "k1", "k2"]).select("id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    ids = vectors.select(F.col(id_col).cast("bigint").alias("vec_id")).distinct()
    full = ids.join(result, ids["vec_id"] == result["id"], "left")
    component = F.coalesce("component", "vec_id")
    return full.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
