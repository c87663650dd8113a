"""Column profile: one output row per numeric column, in one pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decimal places of a mean. Values whose size is under LARGE are summed as decimals of so many places, which no plan changes.
SCALE, LARGE = 4, 1e15


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, exact distinct count, min, max and mean of each column.

    Values become (column, value) rows inside the scan's stage, so one partial
    aggregate by (column, value) serves every statistic, and the exact distinct
    count is a plain count of its groups. A column that holds one value a third
    of the time collapses before the shuffle. Means of values under LARGE in
    size come from decimal sums of values rounded to SCALE places, and agree
    between runs and plans. One value of LARGE or more, infinite or NaN makes
    its column's mean a sum of doubles, NaN or infinite where that sum is.
    Spark's order holds: NaN is the largest value, and equals itself.

    An empty table gives no rows. A column of nulls gives its counts, with null
    min, max and mean. Repeated rows count as often as they come. Columns that
    are not profiled are never read.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    fits = F.abs("value") < LARGE
    exact = F.when(fits, F.col("value")).cast(f"decimal(20,{SCALE})") * F.col("n").cast("decimal(15,0)")
    known = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    plain = F.sum(F.col("value") * F.col("n"))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.when(F.min(fits), F.round(F.sum(exact).cast("double") / known, SCALE)).otherwise(plain / known).alias("mean_value"),
    )
