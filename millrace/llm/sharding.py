"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's key hashes into one of `n_slots` slots for ever. A small versioned
map says which shard holds which slot. Adding a shard, or evening out bytes,
edits the map: a new version is stored, and only the slots it names move.

The map has n_slots rows at most, a parameter; that bound is why it may be
broadcast and why a window over it may be global.

Nulls, ties, repeats: a null key is a key of its own (slot of the empty
string); rows with equal keys share a slot. An empty table gives no rows.
Extra columns are never read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import spread

N_SLOTS = 4096
MAP_SCHEMA = "version int, slot bigint, shard int"


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The fixed slot of a key: it never depends on the number of shards or on the data."""
    return spread(F.coalesce(key.cast("string"), F.lit("")), n_slots)


def slot_bytes(records: DataFrame, key: str, size: str, n_slots: int = N_SLOTS) -> DataFrame:
    """(slot, n_rows, bytes): partial sums before the shuffle, n_slots rows after it."""
    return records.groupBy(slot_of(F.col(key), n_slots).alias("slot")).agg(F.count("*").alias("n_rows"), F.sum(size).alias("bytes"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: slots dealt round robin, so shards differ by one slot at most. The data play no part."""
    return spark.range(0, n_slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").alias("slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def grow(slot_map: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The map's next version, for n_shards + 1 shards: each shard gives up its slots beyond the new quota, none moves elsewhere.

    Which slots go is by their hash, so (key, number of shards) alone decides a row's shard.
    """
    quota = -(-n_slots // (n_shards + 1))
    order = Window.partitionBy("shard").orderBy(F.md5(F.col("slot").cast("string")), "slot")
    return slot_map.withColumn("_rank", F.row_number().over(order)).select(
        (F.col("version") + 1).alias("version"), "slot", F.when(F.col("_rank") > quota, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The map's next version, with bytes evened out by moving whole slots off shards above the mean.

    A shard keeps its largest slots while their running sum stays within the
    mean. The rest are laid end to end, as are the gaps below the mean, and a
    slot goes to the shard whose gap holds the middle of the slot's stretch.
    Slots without rows stay. A slot larger than the mean stays alone in its
    shard: a slot is the unit that moves.

    One shard's stretch is counted in units of 1 / (2 n_shards) bytes, so all
    sums are whole numbers.
    """
    everything = Window.partitionBy(F.lit(0))
    held = slot_map.join(F.broadcast(sizes.select("slot", "bytes")), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    held = held.withColumn("total", F.sum("bytes").over(everything)).withColumn("run", F.sum("bytes").over(in_shard.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(in_shard))
    held = held.withColumn("stays", (F.col("place") == 1) | (F.col("bytes") == 0) | (F.col("run") * n_shards <= F.col("total")))
    movers = held.filter("not stays").withColumn("upto", F.sum("bytes").over(everything.orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)))
    loads = held.groupBy("shard").agg(F.first("total").alias("total"), F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load"))
    shards = slot_map.sparkSession.range(0, n_shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
    loads = shards.join(loads, "shard", "left").select("shard", (F.coalesce("total", F.max("total").over(everything)) - F.coalesce("load", F.lit(0)) * n_shards).alias("gap"))
    gaps = loads.filter("gap > 0").withColumn("upto", F.sum("gap").over(everything.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    # A gap's beginning and a slot's middle on one line: the last gap begun takes the slot.
    line = gaps.select(((F.col("upto") - F.col("gap")) * 2).alias("at"), F.lit(None).cast("bigint").alias("slot"), F.col("shard").alias("to"))
    line = line.union(movers.select(((F.col("upto") * 2 - F.col("bytes")) * n_shards).alias("at"), "slot", F.lit(None).cast("int").alias("to")))
    begun = everything.orderBy("at", F.col("slot").isNotNull(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = line.withColumn("to", F.last("to", ignorenulls=True).over(begun)).filter("slot is not null").select("slot", "to")
    return held.join(F.broadcast(moved), "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a version beside the earlier ones; a stored version is never changed, and storing it again is an error."""
    versions = [r.version for r in slot_map.select("version").distinct().limit(2).collect()]
    if len(versions) != 1:
        raise ValueError("a map to store has one version")
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={versions[0]}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named version of a stored map, else the latest."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version")
    return stored.filter(F.col("version") == version)


def assign(records: DataFrame, key: str, slot_map: DataFrame, n_slots: int = N_SLOTS, name: str = "shard") -> DataFrame:
    """records with the shard of each row; the map is broadcast, the rows don't move."""
    lookup = slot_map.select(F.col("slot").alias("_map_slot"), F.col("shard").alias(name))
    return records.withColumn("_slot", slot_of(F.col(key), n_slots)).join(F.broadcast(lookup), F.col("_slot") == F.col("_map_slot")).drop("_slot", "_map_slot")


def positions(records: DataFrame, shard: str, slot: str, columns: list[str]) -> DataFrame:
    """Each row's place in its shard, without gaps from 0, in (slot, hash, columns) order.

    No task sorts a shard. Rows equal in every column collapse to one with a
    count before the shuffle; the rest are numbered inside (slot, 16ths by
    hash), and the offsets of those cells are sums over a table of 16 times
    n_slots rows at most. So neither a hot key nor a run of repeats meets in
    one sort.
    """
    cell = spread(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 16).alias("cell")
    distinct = records.groupBy(shard, slot, cell, *columns).agg(F.count("*").alias("copies"))
    cells = distinct.groupBy(shard, slot, "cell").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy(shard).orderBy(slot, "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col(slot).alias("_s"), F.col("cell").alias("_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(slot, "cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    numbered = distinct.withColumn("upto", F.sum("copies").over(inside))
    return (
        numbered.join(F.broadcast(cells), (F.col(slot) == F.col("_s")) & (F.col("cell") == F.col("_c")))
        .withColumn("position", F.explode(F.sequence(F.col("offset") + F.col("upto") - F.col("copies"), F.col("offset") + F.col("upto") - 1)))
        .drop("_s", "_c", "offset", "upto", "copies", "cell")
    )
