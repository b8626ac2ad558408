"""As-of join: each row with the last row of the other side that isn't later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, slice_seconds: int) -> DataFrame:
    """left_row, right_row: every row of left with the last row of right of equal keys and right_time <= left_time; null without one.

    Both sides are put together and windowed by key and slice of time, so that a hot key
    is cut into slices of `slice_seconds`. A slice begins with the last row of those before
    it: of each slice one row is kept for that, and these are windowed by key alone. Of
    rows of right at one time the greatest by value counts. Null keys and times meet nothing.
    """
    side = lambda df, at, left_row, right_row: df.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(on)), F.col(at).cast("timestamp").alias("_t"), left_row.alias("left_row"), right_row.alias("right_row"))
    nothing = lambda df: F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType)
    a = side(left, left_time, F.struct(*left.columns), nothing(right))
    b = side(right, right_time, nothing(left), F.struct(*right.columns)).where("_t is not null")
    keys = [f"_k{k}" for k in range(len(on))]
    both = a.unionByName(b).withColumn("_slice", F.floor(F.unix_micros("_t") / (slice_seconds * 1_000_000)))
    # Rows of right come before those of left at the same time.
    order = [F.col("_t"), F.col("left_row").isNotNull(), F.col("right_row")]
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("right_row", ignorenulls=True).over(upto))
    newest = F.max(F.when(F.col("right_row").isNotNull(), F.struct("_t", "right_row")))["right_row"]
    slices = both.groupBy(*keys, "_slice").agg(newest.alias("_newest"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_newest", ignorenulls=True).over(before).alias("_before"))
    # Plain equality of keys: a null key finds no slice, and so no row.
    there: Column = F.lit(True)
    for k in keys:
        there &= F.col(f"i.{k}") == F.col(f"c.{k}")
    rows = inside.where("left_row is not null").alias("i").join(carried.alias("c"), there & (F.col("i._slice") == F.col("c._slice")), "left")
    known = F.lit(True)
    for k in keys:
        known &= F.col(f"i.{k}").isNotNull()
    found = F.when(known & F.col("i._t").isNotNull(), F.coalesce("i._last", "c._before"))
    return rows.select("i.left_row", found.alias("right_row"))
