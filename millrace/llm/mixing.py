"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are ranged
by that key: the key's leading digits name a range, ranges are summed, and
running sums over the ranges, level by level, give each range its offset. Inside
a range a window finishes the prefix sum, so a hot source is as many tasks as
it has ranges, and no task sums more than 16 ** PART ranges. The prefix sum decides how often a document is taken: whole
epochs first, then documents in key order until the source's budget is spent;
the document on the edge gives just the words that are missing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, written

#: Rows that a key range holds at most on average, and digits of ranges that one window sums over.
RANGE_ROWS, PART = 2000, 3


def targets(sizes: DataFrame, weights: list[float], ratio: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn. Targets
    share ratio times all sizes by weight; none is above cap times its source's
    size, and what that frees is shared again by weight until none is above.
    That fixed point is a level L with target = min(cap * size, L * weight):
    with sources sorted by cap * size / weight, a prefix of them is capped, and
    prefix sums give the level. One row per source; a window over them is global.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_goal", F.sum("source_size").over(every) * F.lit(float(ratio)))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    # The level if all earlier sources, and no later one, are capped; the least of these that caps no further source is the one that holds.
    ranked = ranked.withColumn("_level", (F.col("_goal") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("_holds", F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_i"), F.col("_level").alias("level")))).over(every)["level"])
    return ranked.select(*sizes.columns, F.when(F.col("_holds").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_holds") * F.col("_w"))).alias("target"))


def offsets(cells: DataFrame, digits: int) -> DataFrame:
    """cells with _offset, what the ranges before theirs in the source sum to.

    A window sums the ranges that share all but the last PART digits, 16 ** PART
    rows at most; the sums of those groups are ranges of fewer digits.
    """
    short = max(0, digits - PART)
    group = F.substring("_range", 1, short)
    upto = Window.partitionBy("_place", "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("_group", group).withColumn("_offset", F.coalesce(F.sum("_cell").over(upto), F.lit(0)))
    if not short:
        return inside.drop("_group")
    above = cells.groupBy("_place", group.alias("_range")).agg(F.sum("_cell").alias("_cell"))
    above = offsets(above, short).select("_place", F.col("_range").alias("_group"), F.col("_offset").alias("_before"))
    return inside.join(above, ["_place", "_group"]).withColumn("_offset", F.col("_offset") + F.col("_before")).drop("_group", "_before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, seed: int = 17, keep: list[str] = ()) -> DataFrame:
    """Each document with size, source_size, target and taken (words the mix takes, repeats counted).

    Null text: size 0, taken 0. Null source: a source of its own, last. Null or
    repeated ids: the key hashes text too, and rows that still tie are alike.
    Sources without words have target 0. No document is taken above
    ceil(cap) times. Very long texts are counted whole. An empty table gives no rows. `keep` names further columns
    to carry, which must not have the names of results (ValueError); others are
    dropped at once, so their names can't clash.
    """
    if set(keep) & {"size", "source_size", "target", "taken"}:
        raise ValueError("a kept column has the name of a result")
    columns = list(dict.fromkeys([id_col, source_col, *keep]))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    place = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    base = docs.select(*columns, F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("_key"), place.alias("_place"))
    lean = written(base.select(id_col, source_col, "size", "_key", "_place"), "mix-sizes")
    rows = lean.count()
    # A range's name is the key's first digits, of 16 kinds each; sums of ranges go up digit by digit, PART digits at a time.
    digits = max(1, math.ceil(math.log(max(1, rows / RANGE_ROWS), 16)))
    cell = F.substring("_key", 1, digits)
    cells = lean.groupBy("_place", cell.alias("_range")).agg(F.first(source_col).alias("source"), F.sum("size").alias("_cell"))
    cells = written(cells, "mix-ranges")
    totals = cells.groupBy("_place").agg(F.first("source").alias("source"), F.sum("_cell").alias("source_size"))
    goal = targets(totals, list(weights), ratio, cap).select("_place", "source_size", "target")
    cells = offsets(cells, digits).join(goal, "_place").select("_place", "_range", "_offset", "source_size", "target")
    inside = Window.partitionBy("_place", "_range").orderBy("_key", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    run = (base if keep else lean).withColumn("_range", cell).withColumn("_run", F.sum("size").over(inside))
    joined = run.join(cells, ["_place", "_range"])
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    edge = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_offset") + F.col("_run") - F.col("size"))))
    return joined.select(*columns, "size", "source_size", "target", (epochs * F.col("size") + edge).cast("bigint").alias("taken"))


def drawn(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, a row for each time that a document is taken, with its text; the edge document's last turn ends after its missing words.

    Documents without words are never drawn. The extra columns size, source_size, target and taken go.
    """
    turns = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.filter("taken > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), turns)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_turn") - 1) * F.col("size"))
    # Possessive: Java then loops, where a plain group would recurse for each word.
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col(text_col), pattern, F.lit(0))
    return rows.withColumn(text_col, F.when(words < F.col("size"), head).otherwise(F.col(text_col))).drop("_turn", "size", "source_size", "target", "taken")
