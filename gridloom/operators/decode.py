"""Fetch and decode: rows of tiles become rows of arrays, or of pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RasterError, UnsupportedCompression, UnsupportedLayout
from ..sources.storage import Read, closed, range_reader
from .codecs import Decoder, registry
from .predictors import unpredicted

KEY = ["path", "ifd_idx", "x", "y", "band"]
#: Bytes between two ranges that are read along rather than asked for apart, and the most that one read holds.
GAP, MOST = 1 << 16, 16 << 20
#: Bytes of a file whose tiles one task reads.
STRETCH = 1 << 18
#: Codecs that give samples in native order, whatever the file's.
NATIVE_ORDER = (34712, 34887)


def islands(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, list[int]]]:
    """start, stop and members of the reads that cover ranges."""
    out: list[tuple[int, int, list[int]]] = []
    for k in sorted(range(len(ranges)), key=ranges.__getitem__):
        a, z = ranges[k]
        if out and a <= out[-1][1] + gap and max(z, out[-1][1]) - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], z), [*out[-1][2], k])
        else:
            out.append((a, z, [k]))
    return out


def _contents(b: pa.RecordBatch, reader: Callable[[str], Read], open_: dict[str, Read], permissive: bool = False) -> dict[int, bytes | Exception]:
    """The compressed bytes of each row, by one read for an island of ranges of a file; if permissive, the error where a file can't be read."""
    paths, starts, stops = (b.column(c).to_pylist() for c in ("path", "start", "stop"))
    rows: dict[str, list[int]] = {}
    for k, p in enumerate(paths):
        rows.setdefault(p, []).append(k)
    out: dict[int, bytes | Exception] = {}
    for p, own in rows.items():
        try:
            if p not in open_:
                for old in open_.values():  # a task goes from file to file
                    closed(old)
                open_.clear()
                open_[p] = reader(p)
            found = islands([(starts[k], stops[k]) for k in own])
            many = getattr(open_[p], "many", None)
            answers = many([(a, z) for a, z, _ in found]) if many else (open_[p](a, z) for a, z, _ in found)
            for (a, _, members), data in zip(found, answers, strict=True):
                for m in members:
                    k = own[m]
                    out[k] = data[starts[k] - a : stops[k] - a]
        except OSError as e:
            if not permissive:
                raise
            out.update(dict.fromkeys(own, e))
    return out


def near_each_other(tiles: DataFrame) -> DataFrame:
    """Tiles dealt to tasks by stretches of their files, so that a task reads contiguous bytes. No sample is taken, which would scan the files twice."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "path", F.floor(F.col("start") / STRETCH)).sortWithinPartitions("path", "start")


def fetch(tiles: DataFrame, reader: Callable[[str], Read] = range_reader) -> DataFrame:
    """tiles with content, their compressed bytes."""
    names = tiles.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Read] = {}
        for whole in it:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                got = _contents(b, reader, open_)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([got[k] for k in range(b.num_rows)], pa.binary())], [*names, "content"])

    return near_each_other(tiles).mapInArrow(run, T.StructType([*tiles.schema.fields, T.StructField("content", T.BinaryType())]))


def samples(content: bytes, t: dict, decoders: dict[int, Decoder]) -> np.ndarray:
    """A tile, or a band of it, as an array (height, width, samples)."""
    if t["compression"] not in decoders:
        raise UnsupportedCompression(f"compression {t['compression']}")
    if t["dtype"] is None:
        raise UnsupportedLayout("samples of no single known type")
    height, width, n = t.get("held_rows") or t["tile_height"], t["tile_width"], 1 if t["band"] is not None else t["samples_per_pixel"]
    data = decoders[t["compression"]](content, t)
    order = "=" if t["compression"] in NATIVE_ORDER else "<" if t["endianness"] == "little" else ">"
    if t["dtype"] == "bool":
        if (t["predictor"] or 1) != 1:
            raise UnsupportedLayout("a predictor on single bits")
        if t.get("held_rows"):  # the rows of strips begin with a byte each
            row = -(-width * n // 8)
            if len(data) < height * row:
                raise UnsupportedLayout("too few bytes of bits")
            return np.unpackbits(np.frombuffer(data, np.uint8, height * row).reshape(height, row), axis=1, count=width * n).astype(bool).reshape(height, width, n)
        count = height * width * n
        if len(data) < -(-count // 8):
            raise UnsupportedLayout("too few bytes of bits")
        return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool).reshape(height, width, n)
    return unpredicted(data, t["predictor"] or 1, order, t["dtype"], height, width, n)


#: What a tile's mask is, for those that have one: see tiles.with_masks.
MASK = "mask"


def _decoded(it: Iterator[pa.RecordBatch], reader: Callable[[str], Read], decoders: dict[int, Decoder], mode: str) -> Iterator[tuple[dict, np.ndarray | None, str | None]]:
    """Each tile's row with its array, or else the error. A mask's bits are put into the row's place for it."""
    open_: dict[str, Read] = {}
    permissive = mode == "PERMISSIVE"

    def array(t: dict, content: bytes | Exception) -> np.ndarray:
        if isinstance(content, Exception):
            raise content
        return samples(content, t, decoders)

    for whole in it:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            held = "content" in b.schema.names
            got = None if held else _contents(b, reader, open_, permissive)
            rows, masks = b.to_pylist(), {}
            if MASK in b.schema.names and (own := [k for k, t in enumerate(rows) if t[MASK]]):
                asked = pa.RecordBatch.from_pylist([{"path": rows[k]["path"], "start": rows[k][MASK]["start"], "stop": rows[k][MASK]["stop"]} for k in own])
                masks = {own[i]: c for i, c in _contents(asked, reader, open_, permissive).items()}
            for k, t in enumerate(rows):
                try:
                    a = array(t, t["content"] if held else got[k])
                    if k in masks:
                        t[MASK] = array(t | t[MASK], masks[k])[:, :, 0].astype(bool)
                    yield t, a, None
                except Exception as e:
                    if not permissive or not isinstance(e, (RasterError, OSError, ValueError)) and not type(e).__module__.startswith(("zlib", "_lzma", "zstandard", "lzma")):
                        raise
                    yield t, None, f"{type(e).__name__}: {e}"


def decode(tiles: DataFrame, decoders: dict[int, Decoder] | None = None, reader: Callable[[str], Read] = range_reader, mode: str = "FAILFAST") -> DataFrame:
    """path, ifd_idx, x, y, band, dtype, shape, data, error: whole tiles with their padding, as little-endian bytes; a bool takes a byte."""
    known = registry(decoders)
    schema = pa.schema([("path", pa.string()), ("ifd_idx", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("band", pa.int32()), ("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary()), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, array, error in _decoded(it, reader, known, mode):
            row = {c: t[c] for c in (*KEY, "dtype")} | {"shape": None, "data": None, "error": error}
            if array is not None:
                shape = array.shape if t["band"] is None else (1, *array.shape[:2])
                row |= {"shape": list(shape), "data": array.astype(array.dtype.newbyteorder("<")).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return (tiles if "content" in tiles.columns else near_each_other(tiles)).mapInArrow(run, "path string, ifd_idx int, x int, y int, band int, dtype string, shape array<int>, data binary, error string")


def assembled(decoded: DataFrame) -> DataFrame:
    """Tiles whose bands lie apart, put together as (bands, height, width)."""
    parts = F.sort_array(F.collect_list(F.struct("band", "data")))
    whole = decoded.where("band is not null and error is null").groupBy("path", "ifd_idx", "x", "y", "dtype").agg(parts.alias("p"), F.any_value("shape").alias("s"))
    data = F.aggregate("p", F.lit(b""), lambda held, q: F.concat(held, q["data"]))
    return whole.select("path", "ifd_idx", "x", "y", "dtype", F.concat(F.array(F.size("p")), F.slice("s", 2, 2)).alias("shape"), data.alias("data"))


def pixels(tiles: DataFrame, value: str = "double", keep: tuple[str, ...] = (), decoders: dict[int, Decoder] | None = None, reader: Callable[[str], Read] = range_reader, mode: str = "FAILFAST") -> DataFrame:
    """path, ifd_idx, row, col, band, value: a row for each sample inside the image; padding is cut off.

    value: double, bigint, or decimal(20,0), which holds every 64-bit sample. Columns of tiles named in keep come along.
    Of tiles with a mask, samples that it leaves out have no row. PERMISSIVE adds a column error, and a tile that
    can't be read or decoded is one row of it, without row, col and value.
    """
    known = registry(decoders)
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
    permissive = mode == "PERMISSIVE"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, array, error in _decoded(it, reader, known, mode):
            if array is None:
                rows = cols = bands = flat = np.zeros(1, "i8")
            else:
                top, left = t["y"] * t["tile_height"], t["x"] * t["tile_width"]
                array = array[: max(0, t["image_height"] - top), : max(0, t["image_width"] - left)]
                rows, cols, bands = (x.ravel() for x in np.indices(array.shape))
                flat, rows, cols = array.ravel(), rows + top, cols + left
                if isinstance(t.get(MASK), np.ndarray):
                    seen = np.repeat(t[MASK][: array.shape[0], : array.shape[1]].ravel(), array.shape[2])
                    rows, cols, bands, flat = rows[seen], cols[seen], bands[seen], flat[seen]
            n = len(flat)
            none = lambda kind: pa.nulls(n, kind)
            numbers = none(kinds[value]) if error else pa.array(flat.astype("f8")) if value == "double" else pa.array(flat.astype("i8")) if value == "bigint" else pa.array([int(v) for v in flat], kinds[value])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(t["path"]), n),
                    pa.repeat(pa.scalar(t["ifd_idx"], pa.int32()), n),
                    none(pa.int64()) if error else pa.array(rows),
                    none(pa.int64()) if error else pa.array(cols),
                    pa.array(bands.astype("i4")) if t["band"] is None and not error else pa.repeat(pa.scalar(t["band"], pa.int32()), n),
                    numbers,
                    *(pa.repeat(pa.scalar(t[c], b_type), n) for c, b_type in kept.items()),
                    *([pa.repeat(pa.scalar(error, pa.string()), n)] if permissive else []),
                ],
                ["path", "ifd_idx", "row", "col", "band", "value", *kept, *(["error"] if permissive else [])],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kept = {c: to_arrow_type(tiles.schema[c].dataType) for c in keep}
    fields = [*T._parse_datatype_string(f"path string, ifd_idx int, row bigint, col bigint, band int, value {value}").fields, *(tiles.schema[c] for c in keep)]
    fields += [T.StructField("error", T.StringType())] if permissive else []
    return (tiles if "content" in tiles.columns else near_each_other(tiles)).mapInArrow(run, T.StructType(fields))


def array_row(data: bytes, shape: tuple[int, ...], dtype: str) -> dict:
    """A row as decode makes them, of a user's own bytes: little-endian samples of that shape; ValueError if they aren't as many."""
    kind = np.dtype("?" if dtype == "bool" else dtype)
    if len(data) != kind.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{len(data)} bytes are no {dtype} array of shape {tuple(shape)}")
    return {"dtype": dtype, "shape": list(shape), "data": bytes(data)}


def to_numpy(row) -> np.ndarray:
    """A decoded row, once it is on the driver, as a read-only array of its shape."""
    kind = np.dtype("?" if row["dtype"] == "bool" else row["dtype"]).newbyteorder("<")
    return np.frombuffer(bytes(row["data"]), kind).reshape(row["shape"])
