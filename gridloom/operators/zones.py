"""Zone maps: what values each tile holds, as an index that predicates on values consult before any tile is read.

A row of the index stands for a band of a tile and has its count, least and greatest
value, and two sketches that merge: of distinct values and of quantiles. Tiles whose range
misses a predicate's are never fetched; statistics of whole images come from the
index alone. NaN counts as greater than any number, as it does in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["path", "ifd_idx", "x", "y"]


def zone_map(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """path, ifd_idx, x, y, band, n, n_nodata, least, most, distinct_sketch, quantile_sketch of pixels that kept x and y.

    A tile's pixels are in one task, so that one row a tile is shuffled. Pixels of the value nodata only count as such.
    """
    gone = F.col("value") == nodata if nodata is not None else F.lit(False)
    seen = F.when(~gone, F.col("value"))
    return pixels.groupBy(*PLACE, "band").agg(
        F.count(seen).alias("n"), F.count_if(gone).alias("n_nodata"), F.min(seen).alias("least"), F.max(seen).alias("most"),
        F.hll_sketch_agg(seen.cast("string")).alias("distinct_sketch"), F.kll_sketch_agg_double(seen).alias("quantile_sketch"),
    )


def matching(tiles: DataFrame, index: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The tiles that can hold a value from low to high; None leaves an end open. Tiles that the index doesn't know are kept out."""
    can = F.col("n") > 0
    if low is not None:
        can &= F.col("most") >= low
    if high is not None:
        can &= F.col("least") <= high
    return tiles.join(index.where(can).select(*PLACE), PLACE, "left_semi")


def between(pixels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    out = pixels if low is None else pixels.where(F.col("value") >= low)
    return out if high is None else out.where(F.col("value") <= high)


def summary(index: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """path, ifd_idx, band, n, least, most, n_distinct, quantiles of whole images, from the index only; the last two are estimates."""
    merged = index.where("n > 0").groupBy("path", "ifd_idx", "band").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("quantile_sketch").alias("q"))
    at = F.array(*(F.kll_sketch_get_quantile_double("q", F.lit(q)) for q in quantiles))
    return merged.select("path", "ifd_idx", "band", "n", "least", "most", F.hll_sketch_estimate("d").alias("n_distinct"), at.alias("quantiles"))
