"""The relation tiles, and plans of byte ranges over it. Filters on it act before any pixel byte is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(directories: DataFrame) -> DataFrame:
    """tiles_across and tiles_down of each directory; null where it has no tiles."""
    up = lambda a, b: F.ceil(F.col(a) / F.col(b)).cast("int")
    return directories.withColumn("tiles_across", up("image_width", "tile_width")).withColumn("tiles_down", up("image_height", "tile_height"))


#: What decoding a tile needs of its directory.
PARAMETERS = ["endianness", "image_width", "image_height", "tile_width", "tile_height", "bits_per_sample", "samples_per_pixel", "compression", "predictor", "photometric_interpretation", "planar_configuration", "jpeg_tables", "lerc_parameters", "dtype"]


def tiles(directories: DataFrame, *keep: str) -> DataFrame:
    """path, ifd_idx, x, y, band, start, stop and the parameters: a row for each tile; band is null unless the bands lie apart.

    Tile k of a band is at (k mod across, k div across); a band's tiles follow the
    band's before. Tiles beyond the grid give no row. Strips are tiles as wide as the image, of
    rows_per_strip rows; held_rows, null for tiles, has the rows of each, as the last strip may be short.
    """
    strips = F.col("tile_offsets").isNull() & F.col("strip_offsets").isNotNull()
    rows = F.least(F.coalesce("rows_per_strip", "image_height"), F.col("image_height"))
    either = {
        "_stripped": strips, "tile_width": F.when(strips, F.col("image_width")).otherwise(F.col("tile_width")), "tile_height": F.when(strips, rows).otherwise(F.col("tile_height")),
        "tile_offsets": F.coalesce("tile_offsets", "strip_offsets"), "tile_byte_counts": F.when(strips, F.col("strip_byte_counts")).otherwise(F.col("tile_byte_counts")),
    }
    at = grid(directories.withColumns(either)).where("tile_offsets is not null and tile_byte_counts is not null")
    cols = ["path", "ifd_idx", *PARAMETERS, *keep]
    each = at.select(*cols, "_stripped", "tiles_across", "tiles_down", F.posexplode(F.arrays_zip("tile_offsets", "tile_byte_counts")).alias("k", "r"))
    apart, a_band = F.col("planar_configuration") == 2, F.col("tiles_across") * F.col("tiles_down")
    each = each.where(F.col("k") < F.when(apart, a_band * F.col("samples_per_pixel")).otherwise(a_band))
    in_band = F.col("k") % a_band
    return each.select(
        *cols,
        (in_band % F.col("tiles_across")).cast("int").alias("x"),
        F.floor(in_band / F.col("tiles_across")).cast("int").alias("y"),
        F.when(apart, F.floor(F.col("k") / a_band).cast("int")).alias("band"),
        F.when(F.col("_stripped"), F.least(F.col("tile_height"), F.col("image_height") - F.floor(in_band / F.col("tiles_across")) * F.col("tile_height")).cast("int")).alias("held_rows"),
        F.col("r.tile_offsets").alias("start"),
        (F.col("r.tile_offsets") + F.col("r.tile_byte_counts")).alias("stop"),
    )


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Tiles of images with the tile of their file's mask at the same place, so that a task reads both and no pixel is shuffled.

    A file has one mask directory, of the same grid; tiles without a mask are left out.
    """
    own = masks.select("path", "x", "y", F.struct("start", "stop", "compression", "predictor", "dtype", "endianness", "tile_width", "tile_height", "samples_per_pixel", "band", "held_rows").alias("mask"))
    return images.join(own, ["path", "x", "y"])


def requested(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tiles named by the rows (ifd_idx, x, y) of wanted."""
    return found.join(wanted, ["ifd_idx", "x", "y"], "left_semi")


def ordered(found: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """ordinal, missing and the tiles that the rows (ordinal, path, ifd_idx, x, y) of wanted name, one for each row and band; wanted rows may repeat.

    A tile that isn't there is an error; unless strict it is a row whose `missing` says so, and which has no start.
    """
    own = wanted.select("ordinal", *(F.col(c).alias(f"_{c}") for c in ("path", "ifd_idx", "x", "y")))
    met = own.join(found, (F.col("_path") == F.col("path")) & (F.col("_ifd_idx") == F.col("ifd_idx")) & (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")), "left")
    said = F.concat(F.lit("no tile ("), F.concat_ws(", ", *(F.coalesce(F.col(f"_{c}").cast("string"), F.lit("null")) for c in ("ifd_idx", "x", "y"))), F.lit(") in "), F.coalesce("_path", F.lit("null")))
    missing = F.when(F.col("start").isNull(), F.raise_error(said).cast("string") if strict else said)
    told = {c: F.coalesce(c, f"_{c}") for c in ("path", "ifd_idx", "x", "y")}
    return met.withColumn("missing", missing).withColumns(told).drop(*(f"_{c}" for c in told))


#: Ranges that one task sorts, on average.
RANGES = 500_000


def coalesced(ranges: DataFrame, gap: int = 0) -> DataFrame:
    """path, start, stop, n_ranges: ranges (path, start, stop) merged where at most `gap` bytes part them.

    They are counted, so that tasks grow in number and not in memory; a path's ranges stay together.
    """
    parts = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranges.count() // RANGES))
    ranges = ranges.repartition(parts, "path")
    w = Window.partitionBy("path").orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col("start") > seen + gap), 1).otherwise(0)
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("new", new).withColumn("island", island).groupBy("path", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_ranges")).drop("island")
