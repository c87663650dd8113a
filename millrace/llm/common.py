"""What the operators share: the shared folder, intermediate tables, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What lets go of that which operators keep in a Python worker between tasks.
FORGET: list[Callable[[], None]] = []
#: White space that parts words: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it; names are the same in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """(docs with all but the used columns renamed, the new names, what restores names and order afterwards): no name can clash then."""
    rest = [c for c in docs.columns if c not in used]
    named = {c: c if c in used else f"carried_{rest.index(c)}" for c in docs.columns}
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    apart = docs.select(*[F.col(quoted(c)).alias(named[c]) for c in docs.columns])
    return apart, [named[c] for c in rest], lambda df: df.select(*[F.col(named[c]).alias(c) for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends there, and a lost executor costs nothing upstream.

    The rows read back have the schema of df even when there are none.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written(), once nothing reads them any more, and let Spark delete shuffle files of finished steps."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark, df.millrace_path)
        df.millrace_path = None
    release(spark)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def bucketed(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """df stored by key, so that joins on it don't move df; table and files go at the end, also after a failure."""
    spark, table, path = df.sparkSession, f"millrace_{name}_{uuid.uuid4().hex}", scratch_path(df.sparkSession, name)
    try:
        df.write.format("parquet").bucketBy(partitions(spark), key).option("path", path).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"drop table if exists {table}")
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so for plans that the driver's collector has found to be garbage.

    A plan is garbage only when no Python variable holds its DataFrame, and the
    driver's JVM learns that from Python with a delay; hence the second round.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, n: int, most_bytes: int = 4 << 20) -> Iterator[None]:
    """Inside, Arrow batches take n rows and about most_bytes at most: for steps that run here and whose rows are large."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": n, "spark.sql.execution.arrow.maxBytesPerBatch": most_bytes}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Narrow tables up to this many rows (16 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small; else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(key: Column, n: int) -> Column:
    """A value of 0 to n-1 by the first 32 bits of the MD5 of key, as SQL engines agree on it."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(n)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a step that needs its memory: what other operators keep in this worker goes first, and freed memory goes back to the system at the end."""
    for forget in FORGET:
        forget()
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts take most_bytes at most; a longer text comes alone. No row is left out."""
    at = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + size > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that share keys, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            here = tuple(c[a] for c in columns)
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of the edges (a, b), bigint: the least node that edges reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each
    step hangs a node's neighbours on its least neighbour, until every
    component is a star. Each round is a table in the shared folder; only two
    sums of hashes come to the driver. Minima are partial aggregates and the
    joins are plain equi-joins, so AQE can split a hub.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "edges")
        dropped(now, large)
        now, before = small, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h
