"""Pyramids: smaller and smaller levels of images, each made from the level before.

A pixel of a level stands for two by two of the one below it. Every task reduces the
tiles that it holds, so a quarter of a level's samples is shuffled, once, by the tile of the
next level. Partial pixels merge there: tiles of any size and strips of odd heights may
part the four pixels below. Levels are tables, so a lost executor costs no more than
the level in work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Read, range_reader, shared_path
from .codecs import Decoder, registry
from .decode import _decoded, near_each_other

#: How partial pixels merge, and the value of one without data.
MERGES = {"mean": (np.add, 0.0), "least": (np.fmin, np.nan), "most": (np.fmax, np.nan), "nearest": (np.fmax, np.nan)}

_PIECE = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("ifd_idx", "band", "x", "y")), *((c, pa.int64()) for c in ("image_height", "image_width")), *((c, pa.int32()) for c in ("row", "col", "height", "width", "side")), ("total", pa.binary()), ("n", pa.binary())])
_LEVEL = pa.schema([f for f in _PIECE if f.name not in ("row", "col")])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
PIECE, LEVEL = (", ".join(f"{f.name} {_SQL[f.type]}" for f in s) for s in (_PIECE, _LEVEL))


def halved(total: np.ndarray, n: np.ndarray, top: int, left: int, statistic: str) -> tuple[np.ndarray, np.ndarray]:
    """The partial pixels of the next level of (height, width) at row top, column left of this one."""
    merge, none = MERGES[statistic]
    pad = [(at % 2, (at + size) % 2) for at, size in zip((top, left), total.shape, strict=True)]
    total, n = np.pad(total, pad, constant_values=none), np.pad(n, pad)
    if statistic == "nearest":
        return total[::2, ::2], n[::2, ::2]
    corners = [(total[r::2, c::2], n[r::2, c::2]) for r in (0, 1) for c in (0, 1)]
    return reduce(merge, (t for t, _ in corners)), reduce(np.add, (m for _, m in corners))


def _cut(facts: dict, total: np.ndarray, n: np.ndarray, top: int, left: int, side: int, statistic: str) -> Iterator[dict]:
    """The next level's pieces of some pixels, one for each of its tiles that they reach."""
    total, n = halved(total, n, top, left, statistic)
    top, left = top // 2, left // 2
    for y in range(top // side, (top + total.shape[0] - 1) // side + 1):
        for x in range(left // side, (left + total.shape[1] - 1) // side + 1):
            r0, c0 = max(0, y * side - top), max(0, x * side - left)
            at = np.s_[r0 : (y + 1) * side - top, c0 : (x + 1) * side - left]
            part = np.ascontiguousarray(total[at])
            yield facts | {"x": x, "y": y, "row": top + r0 - y * side, "col": left + c0 - x * side, "height": part.shape[0], "width": part.shape[1], "side": side, "total": part.tobytes(), "n": np.ascontiguousarray(n[at]).tobytes()}


def _next_size(t: dict) -> dict:
    return {"image_height": -(-t["image_height"] // 2), "image_width": -(-t["image_width"] // 2)}


def pyramid(tiles: DataFrame, levels: int | None = None, tile: int = 256, statistic: str = "mean", nodata: float | None = None, reader: Callable[[str], Read] = range_reader, decoders: dict[int, Decoder] | None = None) -> DataFrame:
    """path, ifd_idx, band, x, y, image_height, image_width, height, width, side, total, n, level: the tiles of levels 1 and up of each directory.

    total and n hold doubles and 64-bit counts, row by row: the sum (of mean) or the value, and the number of base
    pixels with data below; without data n is 0. NaN is no data, nor is nodata. nearest takes the pixel at even row and column.
    Without `levels` a directory ends with the level that is one tile. No tiles give no rows, and so does 0 levels.
    """
    merge, none = MERGES[statistic]
    if tile < 1 or levels is not None and levels < 0:
        raise ValueError(f"{levels} levels of tiles of {tile}")
    known, spark = registry(decoders), tiles.sparkSession

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, array, _ in _decoded(it, reader, known, "FAILFAST"):
            top, left = t["y"] * t["tile_height"], t["x"] * t["tile_width"]
            array = array[: max(0, t["image_height"] - top), : max(0, t["image_width"] - left)].astype("f8")
            if not array.size:
                continue
            there = ~np.isnan(array) if nodata is None else ~np.isnan(array) & (array != nodata)
            own = {"path": t["path"], "ifd_idx": t["ifd_idx"]} | _next_size(t)
            rows = [p for k in range(array.shape[2]) for p in _cut(own | {"band": k if t["band"] is None else t["band"]}, np.where(there[:, :, k], array[:, :, k], none), there[:, :, k].astype("i8"), top, left, tile, statistic)]
            yield pa.RecordBatch.from_pylist(rows, _PIECE)

    def further(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                total, n = (np.frombuffer(t[c], kind).reshape(t["height"], t["width"]) for c, kind in (("total", "f8"), ("n", "i8")))
                own = {c: t[c] for c in ("path", "ifd_idx", "band")} | _next_size(t)
                yield pa.RecordBatch.from_pylist(list(_cut(own, total, n, t["y"] * tile, t["x"] * tile, tile, statistic)), _PIECE)

    def join(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ifd_idx, band, x, y = (k.as_py() for k in key)
        total = None
        for b in it:
            for p in b.to_pylist():
                if total is None:
                    size = {c: p[c] for c in ("image_height", "image_width")}
                    shape = min(tile, size["image_height"] - y * tile), min(tile, size["image_width"] - x * tile)
                    total, n = np.full(shape, none), np.zeros(shape, "i8")
                at = np.s_[p["row"] : p["row"] + p["height"], p["col"] : p["col"] + p["width"]]
                total[at] = merge(total[at], np.frombuffer(p["total"], "f8").reshape(p["height"], p["width"]))
                n[at] += np.frombuffer(p["n"], "i8").reshape(p["height"], p["width"])
        yield pa.RecordBatch.from_pylist([{"path": path, "ifd_idx": ifd_idx, "band": band, "x": x, "y": y, **size, "height": shape[0], "width": shape[1], "side": tile, "total": total.tobytes(), "n": n.tobytes()}], _LEVEL)

    large = F.greatest("image_height", "image_width") > tile
    if levels is None:
        longest = tiles.where(large).agg(F.max(F.greatest("image_height", "image_width"))).first()[0] or 0
        levels = next(k for k in range(64) if -(-longest // 2**k) <= tile)
        more = lambda rows: rows.where(large)
    else:
        more = lambda rows: rows
    folder, below, made = shared_path(spark, "pyramid"), None, []
    for level in range(1, levels + 1):
        pieces = near_each_other(more(tiles)).mapInArrow(first, PIECE) if below is None else more(below).mapInArrow(further, PIECE)
        path = f"{folder}/level-{level}"
        pieces.groupBy("path", "ifd_idx", "band", "x", "y").applyInArrow(join, LEVEL).write.parquet(path)
        below = spark.read.schema(LEVEL).parquet(path)
        made.append(below.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], LEVEL + ", level int")


def pyramid_pixels(levels: DataFrame, statistic: str = "mean") -> DataFrame:
    """path, ifd_idx, level, row, col, band, value, n of the pixels of levels that have data; n counts the base pixels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                t = b.slice(k, 1).to_pylist()[0]
                total, n = np.frombuffer(t["total"], "f8"), np.frombuffer(t["n"], "i8")
                at = np.flatnonzero(n)
                # Tiles at the right and lower edge are cut, so the places of others come from their full side.
                fixed = [pa.repeat(pa.scalar(t[c], kind), len(at)) for c, kind in (("path", pa.string()), ("ifd_idx", pa.int32()), ("level", pa.int32()))]
                place = [pa.array(at // t["width"] + t["y"] * t["side"]), pa.array(at % t["width"] + t["x"] * t["side"])]
                value = total[at] / n[at] if statistic == "mean" else total[at]
                yield pa.RecordBatch.from_arrays([*fixed, *place, pa.repeat(pa.scalar(t["band"], pa.int32()), len(at)), pa.array(value), pa.array(n[at])], ["path", "ifd_idx", "level", "row", "col", "band", "value", "n"])

    return levels.mapInArrow(run, "path string, ifd_idx int, level int, row bigint, col bigint, band int, value double, n bigint")


def of_resolution(levels: DataFrame, ifds: DataFrame, wanted: float) -> DataFrame:
    """The levels to read for pixels of the side `wanted` in map units: of each directory the coarsest that is no coarser. A finer wish has no row here; it is for the image itself.

    Directories without a pixel scale have no rows. What is joined is one row for each directory.
    """
    scale = ifds.select("path", "ifd_idx", F.get("model_pixel_scale", F.lit(0)).alias("_scale")).where("_scale > 0")
    told = levels.join(scale, ["path", "ifd_idx"]).where(F.col("_scale") * F.pow(F.lit(2.0), F.col("level")) <= wanted)
    best = told.groupBy("path", "ifd_idx").agg(F.max("level").alias("level"))
    return levels.join(best, ["path", "ifd_idx", "level"], "left_semi")


def stored_of_resolution(ifds: DataFrame, wanted: float) -> DataFrame:
    """Of each file the directory to read for pixels of the side `wanted`: its coarsest image that is no coarser, else its finest.

    Overviews (bit 0 of the subfile type) are as wide as the file's first image; masks (bit 2) don't count. Files
    without a pixel scale count in pixels of their first image.
    """
    bits: Column = F.coalesce("new_subfile_type", F.lit(0).cast("bigint"))
    images = ifds.where(bits.bitwiseAND(F.lit(4)) == 0)
    full = images.where(bits.bitwiseAND(F.lit(1)) == 0).groupBy("path").agg(F.min_by(F.struct(F.col("image_width").alias("w"), F.coalesce(F.get("model_pixel_scale", F.lit(0)), F.lit(1.0)).alias("s")), "ifd_idx").alias("f"))
    sides = images.join(full, "path").select("path", "ifd_idx", (F.col("f.w") / F.col("image_width") * F.col("f.s")).alias("side"))
    fits = F.max_by("ifd_idx", F.when(F.col("side") <= wanted, F.struct("side", -F.col("ifd_idx"))))
    best = sides.groupBy("path").agg(F.coalesce(fits, F.min_by("ifd_idx", F.struct("side", "ifd_idx"))).alias("ifd_idx"))
    return ifds.join(best, ["path", "ifd_idx"], "left_semi")
