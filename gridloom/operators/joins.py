"""Joins of pixels with masks, palettes and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["path", "row", "col"]


def banded(pixels: DataFrame, names: list[str]) -> DataFrame:
    """Pixels with a column for each band, in one aggregation."""
    return pixels.groupBy("path", "ifd_idx", "row", "col").agg(*(F.max(F.when(F.col("band") == k, F.col("value"))).alias(name) for k, name in enumerate(names)))


def masked(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels where a mask directory's sample is 1."""
    return pixels.join(mask.where("value = 1").select(*PLACE), PLACE, "left_semi")


def coloured(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels with red, green, blue of their directory's colormap: 65,536 entries at most for each directory."""
    own = palette.withColumnRenamed("value", "entry")
    return pixels.join(own, (pixels["path"] == own["path"]) & (pixels["ifd_idx"] == own["ifd_idx"]) & (pixels["value"] == own["entry"])).select(pixels["*"], "red", "green", "blue")
