"""Mosaics: overlapping rasters laid on one grid, the pixel of the highest priority on top.

Source tiles are decoded where they are read and cut at the tiles of the output
grid; the pieces are shuffled once, by output tile. A task lays the pieces of a tile
on its canvas as they stream by, in any order, and holds nothing but the canvas and the
priority that each of its pixels came with. Scales may differ: an output
pixel takes the source pixel that its centre falls in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Read, range_reader
from .codecs import Decoder, registry
from .decode import MASK, _decoded, near_each_other

#: Columns of directories that tiles need for a mosaic.
GEO = ("model_pixel_scale", "model_tiepoint")


@dataclass(frozen=True)
class Grid:
    """The output: the map place of its outer corner, the sides of a pixel, its size in pixels and its tiles' side."""

    left: float
    top: float
    step: float
    width: int
    height: int
    tile: int = 256


def sources(places: np.ndarray, tie: float, at: float, side: float, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the output's places fall into the n source pixels from first on, and into which; distances grow with both."""
    which = np.floor((places - tie) / side + at).astype(np.int64)
    inside = np.flatnonzero((which >= first) & (which < first + n))
    return inside, which[inside] - first


def span(grid_n: int, low: float, high: float, step: float) -> np.ndarray:
    """The output's pixels that may lie between two distances from its corner."""
    return np.arange(max(0, int(np.floor(low / step)) - 1), min(grid_n, int(np.ceil(high / step)) + 1))


def pieces(tiles: DataFrame, grid: Grid, nodata: float | None = None, reader: Callable[[str], Read] = range_reader, decoders: dict[int, Decoder] | None = None) -> DataFrame:
    """out_x, out_y, band, priority, tie, row, col, height, width, dtype, data, seen: source tiles cut at output tiles, pixels without data told by seen."""
    known = registry(decoders)
    names = ["out_x", "out_y", "band", "priority", "tie", "row", "col", "height", "width", "dtype", "data", "seen"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, array, _ in _decoded(it, reader, known, "FAILFAST"):
            (sx, sy, *_), (i, j, _, x0, y0, *_) = t["model_pixel_scale"], t["model_tiepoint"]
            top, left = t["y"] * t["tile_height"], t["x"] * t["tile_width"]
            array = array[: max(0, t["image_height"] - top), : max(0, t["image_width"] - left)]
            h, w, n = array.shape
            # Distances to the right and down from the grid's corner.
            cols = span(grid.width, x0 - grid.left + (left - i) * sx, x0 - grid.left + (left + w - i) * sx, grid.step)
            rows = span(grid.height, grid.top - y0 + (top - j) * sy, grid.top - y0 + (top + h - j) * sy, grid.step)
            at_c, from_c = sources((cols + 0.5) * grid.step, x0 - grid.left, i, sx, left, w)
            at_r, from_r = sources((rows + 0.5) * grid.step, grid.top - y0, j, sy, top, h)
            cols, rows = cols[at_c], rows[at_r]
            if not len(cols) or not len(rows):
                continue
            taken = array[np.ix_(from_r, from_c)]
            seen = np.ones(taken.shape[:2], bool)
            if isinstance(t.get(MASK), np.ndarray):
                seen &= t[MASK][np.ix_(from_r, from_c)]
            out = []
            for oy in np.unique(rows // grid.tile):
                for ox in np.unique(cols // grid.tile):
                    r, c = np.flatnonzero(rows // grid.tile == oy), np.flatnonzero(cols // grid.tile == ox)
                    for band in range(n):
                        own = taken[r[0] : r[-1] + 1, c[0] : c[-1] + 1, band]
                        there = seen[r[0] : r[-1] + 1, c[0] : c[-1] + 1] & (own != nodata if nodata is not None else True)
                        if there.any():
                            little = np.ascontiguousarray(own).astype(own.dtype.newbyteorder("<"))
                            out.append((int(ox), int(oy), t["band"] if t["band"] is not None else band, float(t["priority"]), t["tie"], int(rows[r[0]] % grid.tile), int(cols[c[0]] % grid.tile), *own.shape, own.dtype.name, little.tobytes(), np.packbits(there).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    schema = "out_x int, out_y int, band int, priority double, tie bigint, row int, col int, height int, width int, dtype string, data binary, seen binary"
    return near_each_other(tiles.withColumn("tie", F.xxhash64("path", "ifd_idx"))).mapInArrow(run, schema)


def mosaic(tiles: DataFrame, grid: Grid, nodata: float | None = None, reader: Callable[[str], Read] = range_reader, decoders: dict[int, Decoder] | None = None) -> DataFrame:
    """x, y, band, dtype, shape, data, seen: the output's tiles, of its columns across, rows down; seen has a bit for each pixel.

    tiles need the columns GEO and `priority`, a number; of equal ones a hash of the path decides.
    Rasters are north up and of one type. Places that no raster covers are 0, and not seen.
    """
    side = grid.tile

    def lay(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canvas = best = None
        for b in it:
            for p in b.to_pylist():
                own = np.frombuffer(p["data"], np.dtype(p["dtype"]).newbyteorder("<")).reshape(p["height"], p["width"])
                there = np.unpackbits(np.frombuffer(p["seen"], np.uint8), count=own.size).astype(bool).reshape(own.shape)
                if canvas is None:
                    canvas, best, ties = np.zeros((side, side), own.dtype), np.full((side, side), -np.inf), np.full((side, side), np.iinfo(np.int64).min)
                    seen = np.zeros((side, side), bool)
                at = np.s_[p["row"] : p["row"] + p["height"], p["col"] : p["col"] + p["width"]]
                wins = there & (~seen[at] | (p["priority"] > best[at]) | ((p["priority"] == best[at]) & (p["tie"] > ties[at])))
                canvas[at][wins], best[at][wins], ties[at][wins], seen[at][wins] = own[wins], p["priority"], p["tie"], True
        x, y, band = (k.as_py() for k in key)
        yield pa.RecordBatch.from_pylist([{"x": x, "y": y, "band": band, "dtype": canvas.dtype.name, "shape": [side, side], "data": canvas.tobytes(), "seen": np.packbits(seen).tobytes()}], rows)

    rows = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("band", pa.int32()), ("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary()), ("seen", pa.binary())])
    cut = pieces(tiles, grid, nodata, reader, decoders)
    return cut.groupBy("out_x", "out_y", "band").applyInArrow(lay, "x int, y int, band int, dtype string, shape array<int>, data binary, seen binary")


def mosaic_pixels(made: DataFrame) -> DataFrame:
    """row, col, band, value of the pixels of a mosaic that some raster has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b.to_pylist():
                h, w = t["shape"]
                own = np.frombuffer(t["data"], np.dtype(t["dtype"]).newbyteorder("<"))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(t["seen"], np.uint8), count=own.size))
                yield pa.RecordBatch.from_arrays([pa.array(at // w + t["y"] * h), pa.array(at % w + t["x"] * w), pa.repeat(pa.scalar(t["band"], pa.int32()), len(at)), pa.array(own[at].astype("f8"))], ["row", "col", "band", "value"])

    return made.mapInArrow(run, "row bigint, col bigint, band int, value double")
