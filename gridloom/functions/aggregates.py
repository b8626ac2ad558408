"""Aggregates over decoded tiles and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_statistics(pixels: DataFrame) -> DataFrame:
    """ifd_idx, band, n, least, most, mean of the pixels."""
    return pixels.groupBy("ifd_idx", "band").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def histogram(pixels: DataFrame, width: float) -> DataFrame:
    """ifd_idx, band, bin, n: pixels by bins of the given width."""
    return pixels.groupBy("ifd_idx", "band", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))
