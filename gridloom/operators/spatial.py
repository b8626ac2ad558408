"""Joins and windows in space: footprints that overlap, and focal statistics across tile edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedLayout
from ..sources.storage import Read, range_reader
from .codecs import Decoder, registry
from .decode import _decoded, near_each_other

BOX = ("left", "bottom", "right", "top")


def footprints(directories: DataFrame) -> DataFrame:
    """Directories with left, bottom, right, top of their images, from scale and tie point; null without them."""
    scale, tie = (lambda k: F.get("model_pixel_scale", F.lit(k))), (lambda k: F.get("model_tiepoint", F.lit(k)))
    left, top = tie(3) - tie(0) * scale(0), tie(4) + tie(1) * scale(1)
    return directories.withColumns({"left": left, "top": top, "right": left + F.col("image_width") * scale(0), "bottom": top - F.col("image_height") * scale(1)})


def _level(finest: float) -> Column:
    """The least level whose cells, finest * 2^level, are no smaller than the box."""
    side = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom")) / finest
    return F.when(side <= 1, 0).otherwise(F.ceil(F.log2(side))).cast("int")


def _cells(boxes: DataFrame, level: Column, finest: float) -> DataFrame:
    """A row for each of the cells of a level, at most four, that a box meets."""
    side = F.lit(finest) * F.pow(F.lit(2.0), level)
    ends = lambda a, z: F.sequence(F.floor(F.col(a) / side).cast("bigint"), F.floor(F.col(z) / side).cast("bigint"))
    return boxes.withColumn("_at", level).withColumn("_cx", F.explode(ends("left", "right"))).withColumn("_cy", F.explode(ends("bottom", "top")))


def overlapping(a: DataFrame, b: DataFrame, finest: float) -> DataFrame:
    """left_row, right_row: the rows of a and of b whose boxes (left, bottom, right, top, edges included) share a point, once each.

    A box lies in at most four cells of the level of its own size. Pairs meet at the
    level of the larger one: small boxes are put into the cells of each larger level that
    the other side has, and never meet each other there. A pair that shares several cells is
    taken where the lower left corner of its overlap is. Equi-joins only; hot cells are left
    to Spark's skew join. Boxes with nulls or reversed ends meet nothing.

    finest: the side of the smallest cells, about that of a typical box.
    """
    sides = []
    for df in (a, b):
        whole = df.where("left <= right and bottom <= top").select(F.struct("*").alias("_row"), *(F.col(c).cast("double").alias(c) for c in BOX))
        sides.append(whole.withColumn("_level", _level(finest)))
    # A level for each power of two between box sizes: some tens of numbers.
    found = [sorted(r["_level"] for r in s.select("_level").distinct().collect()) for s in sides]

    def coarser(s: DataFrame, levels: list[int]) -> DataFrame:
        higher = F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x > F.col("_level"))
        return _cells(s.withColumn("_higher", F.explode(higher)), F.col("_higher"), finest).drop("_higher")

    own = [_cells(s, F.col("_level"), finest) for s in sides]
    up = [coarser(sides[0], found[1]), coarser(sides[1], found[0])]
    low = lambda c: F.greatest(f"a.{c}", f"b.{c}")
    side = F.lit(finest) * F.pow(F.lit(2.0), F.col("a._at"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.alias("a").join(y.alias("b"), (F.col("a._at") == F.col("b._at")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")))
        touch = (low("left") <= F.least("a.right", "b.right")) & (low("bottom") <= F.least("a.top", "b.top"))
        here = (F.floor(low("left") / side) == F.col("a._cx")) & (F.floor(low("bottom") / side) == F.col("a._cy"))
        return pairs.where(touch & here).select(F.col("a._row").alias("left_row"), F.col("b._row").alias("right_row"))

    return met(own[0], own[1]).unionByName(met(own[0], up[1])).unionByName(met(up[0], own[1]))


#: Statistics of the numbers of a window, of which those without data are NaN.
STATISTICS = {"mean": np.nanmean, "sum": np.nansum, "least": np.nanmin, "most": np.nanmax, "n": lambda w, axis: np.sum(~np.isnan(w), axis=axis)}


def focal(tiles: DataFrame, radius: int, statistic: str = "mean", nodata: float | None = None, keep: tuple[str, ...] = (), reader: Callable[[str], Read] = range_reader, decoders: dict[int, Decoder] | None = None) -> DataFrame:
    """path, ifd_idx, row, col, band, value: of each pixel with data, a statistic of the square window of `radius` pixels around it.

    Each tile is decoded once and sends its edges to its neighbours: one shuffle of the
    samples, and a group is a tile with its halo. Windows end at the image's edge. The
    radius is no more than a tile's side. Integers of 2^53 and more aren't exact.
    """
    known, compute = registry(decoders), STATISTICS[statistic]
    names = ["path", "ifd_idx", "x", "y", "band", "row", "col", "height", "width", "tile_height", "tile_width", "data", *keep]

    def halos(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, array, _ in _decoded(it, reader, known, "FAILFAST"):
            th, tw = t["tile_height"], t["tile_width"]
            if radius > min(th, tw):
                raise UnsupportedLayout(f"a window of radius {radius} on tiles of {tw} x {th}")
            top, left = t["y"] * th, t["x"] * tw
            array = array[: max(0, t["image_height"] - top), : max(0, t["image_width"] - left)].astype("f8")
            h, w, n = array.shape
            across, down = -(-t["image_width"] // tw), -(-t["image_height"] // th)
            out = []
            for ny in range(max(0, t["y"] - 1), min(down, t["y"] + 2)):
                for nx in range(max(0, t["x"] - 1), min(across, t["x"] + 2)):
                    # The part of this tile that lies in the neighbour's window, and where it is there.
                    r0, r1 = max(top, ny * th - radius), min(top + h, (ny + 1) * th + radius)
                    c0, c1 = max(left, nx * tw - radius), min(left + w, (nx + 1) * tw + radius)
                    if r0 < r1 and c0 < c1:
                        part = array[r0 - top : r1 - top, c0 - left : c1 - left]
                        for band in range(n):
                            data = np.ascontiguousarray(part[:, :, band]).tobytes()
                            out.append((t["path"], t["ifd_idx"], nx, ny, t["band"] if t["band"] is not None else band, r0 - ny * th + radius, c0 - nx * tw + radius, r1 - r0, c1 - c0, th, tw, data, *(t[c] for c in keep)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kept = [to_arrow_type(tiles.schema[c].dataType) for c in keep]
    kinds = [pa.string(), *[pa.int32()] * 4, *[pa.int32()] * 6, pa.binary(), *kept]
    schema = "path string, ifd_idx int, x int, y int, band int, row int, col int, height int, width int, tile_height int, tile_width int, data binary"
    extra = "".join(f", `{c}` {tiles.schema[c].dataType.simpleString()}" for c in keep)

    def window(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ifd_idx, x, y, band = (k.as_py() for k in key)
        canvas = None
        for b in it:
            for p in b.to_pylist():
                if canvas is None:
                    th, tw = p["tile_height"], p["tile_width"]
                    canvas, told = np.full((th + 2 * radius, tw + 2 * radius), np.nan), [p[c] for c in keep]
                canvas[p["row"] : p["row"] + p["height"], p["col"] : p["col"] + p["width"]] = np.frombuffer(p["data"], "f8").reshape(p["height"], p["width"])
        if nodata is not None:
            canvas[canvas == nodata] = np.nan
        rows, cols = np.nonzero(~np.isnan(canvas[radius : radius + th, radius : radius + tw]))
        if len(rows):
            windows = np.lib.stride_tricks.sliding_window_view(canvas, (2 * radius + 1, 2 * radius + 1))[rows, cols]
            n = len(rows)
            fixed = [pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(ifd_idx, pa.int32()), n), pa.array(rows + y * th), pa.array(cols + x * tw), pa.repeat(pa.scalar(band, pa.int32()), n), pa.array(compute(windows, axis=(1, 2)).astype("f8"))]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.repeat(pa.scalar(v, k), n) for v, k in zip(told, kept, strict=True))], ["path", "ifd_idx", "row", "col", "band", "value", *keep])

    sent = near_each_other(tiles).mapInArrow(halos, schema + extra)
    return sent.groupBy("path", "ifd_idx", "x", "y", "band").applyInArrow(window, "path string, ifd_idx int, row bigint, col bigint, band int, value double" + extra)
