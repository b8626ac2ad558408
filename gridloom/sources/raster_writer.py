"""Writes rows as tiled rasters, a file for each stretch of keys: the inverse of the engine, for tests and exports.

A row's key is its place: image row key div width, column key mod width. Files hold
`rows` image rows each, and their tie point has the first one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codecs import ENCODERS
from ..operators.predictors import predicted
from .storage import importable, write_file


@dataclass(frozen=True)
class Layout:
    dtype: str
    bands: int = 1
    width: int = 64
    rows: int = 512
    tile: int = 32
    compression: str = "deflate"
    predictor: int = 1
    big_endian: bool = False
    bigtiff: bool = False
    planar: bool = False
    photometric: int = 1
    overview: bool = False
    mask: bool = False
    colormap: tuple[int, ...] = ()
    epsg: int = 0
    #: Replaces the compression's code and bytes, for custom decoders.
    code: int = 0
    xor: int = 0
    #: Further tags: a text, or a field type and its numbers (of rationals numerator and denominator in turn).
    extra: dict[int, str | tuple[int, tuple]] = field(default_factory=dict)
    #: Rows of a strip; 0 writes tiles.
    strip: int = 0
    #: Side of a pixel, and the map place of the first row's outer corner; 0 leaves the raster without a scale, and its tie point has its first row.
    scale: float = 0.0
    left: float = 0.0
    top: float = 0.0


def _entry(tag: int, kind: int, values, order: str) -> tuple[int, int, int, bytes]:
    if kind == 2:
        raw = values.encode() + b"\0"
        return tag, kind, len(raw), raw
    letter = {1: "B", 3: "H", 4: "I", 5: "I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}[kind]
    return tag, kind, len(values) // (2 if kind in (5, 10) else 1), struct.pack(f"{order}{len(values)}{letter}", *values)


def _tiled(image: np.ndarray, how: Layout, order: str) -> list[bytes]:
    """The compressed tiles of (height, width, samples), padded with 0."""
    encode = ENCODERS[how.compression][1]
    height, width, _ = image.shape
    if how.strip:
        bits = lambda t: np.packbits(t.reshape(len(t), -1), axis=1).tobytes()
        bands = np.split(image, image.shape[2], axis=2) if how.planar else [image]
        parts = [np.ascontiguousarray(b[y : y + how.strip]) for b in bands for y in range(0, height, how.strip)]
        return [encode(bits(t) if t.dtype == bool else predicted(t, how.predictor, order)) for t in parts]
    padded = np.pad(image, ((0, -height % how.tile), (0, -width % how.tile), (0, 0)))
    out = []
    for part in np.split(padded, image.shape[2], axis=2) if how.planar else [padded]:
        for y in range(0, padded.shape[0], how.tile):
            for x in range(0, padded.shape[1], how.tile):
                t = np.ascontiguousarray(part[y : y + how.tile, x : x + how.tile])
                data = np.packbits(t).tobytes() if t.dtype == bool else predicted(t, how.predictor, order)
                data = encode(data)
                out.append(bytes(b ^ how.xor for b in data) if how.xor else data)
    return out


def encoded(image: np.ndarray, how: Layout, first_row: int = 0, mask: np.ndarray | None = None) -> bytes:
    """A TIFF of (height, width, bands): the image, its half-size overview and its mask, as the layout has them."""
    order = ">" if how.big_endian else "<"
    pages = [(image, 0)] + ([(image[::2, ::2], 1)] if how.overview else []) + ([(mask, 4)] if how.mask else [])
    offset, count, pad = ("Q", "Q", 8) if how.bigtiff else ("I", "I", 4)
    head = struct.pack(order + ("HHHQ" if how.bigtiff else "HI"), *((43, 8, 0, 16) if how.bigtiff else (42, 8)))
    out = bytearray((b"MM" if how.big_endian else b"II") + head)
    for k, (page, subtype) in enumerate(pages):
        bit = page.dtype == bool
        own = Layout(dtype="bool", tile=how.tile, strip=how.strip, compression=how.compression) if bit else how
        parts = _tiled(page, own, order)
        n = page.shape[2]
        formats = {"u": 1, "i": 2, "f": 3, "b": 1}[page.dtype.kind]
        code = own.code or ENCODERS[own.compression][0]
        sizes = [len(p) for p in parts]
        big, at = 16 if how.bigtiff else 4, 273 if how.strip else 324
        entries = [
            _entry(254, 4, [subtype], order), _entry(256, 4, [page.shape[1]], order), _entry(257, 4, [page.shape[0]], order),
            _entry(258, 3, [1 if bit else page.dtype.itemsize * 8] * n, order), _entry(259, 3, [code], order), _entry(262, 3, [4 if bit else how.photometric], order),
            _entry(277, 3, [n], order), _entry(284, 3, [2 if own.planar else 1], order), _entry(317, 3, [own.predictor], order),
            *([_entry(278, 4, [how.strip], order)] if how.strip else [_entry(322, 4, [how.tile], order), _entry(323, 4, [how.tile], order)]), _entry(at, big, [0] * len(parts), order), _entry(279 if how.strip else 325, big, sizes, order),
            _entry(339, 3, [formats] * n, order), _entry(33922, 12, [0.0, 0.0, 0.0, how.left, how.top - first_row * how.scale if how.scale else float(first_row), 0.0], order),
        ]
        if how.colormap and not bit:
            entries.append(_entry(320, 3, how.colormap, order))
        if how.scale:
            side = how.scale * (2 if subtype == 1 else 1)
            entries.append(_entry(33550, 12, [side, side, 0.0], order))
        if how.epsg:
            entries.append(_entry(34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, how.epsg], order))
        entries += [_entry(t, *((2, v) if isinstance(v, str) else v), order) for t, v in how.extra.items()]
        entries.sort()
        # The directory, then values that don't fit into it, then tiles.
        size = struct.calcsize(order + ("Q" if how.bigtiff else "H")) + len(entries) * (20 if how.bigtiff else 12) + pad
        place, room = len(out) + size, {}
        for tag, _, _, raw in entries:
            if len(raw) > pad:
                place += place % 2
                room[tag] = place
                place += len(raw)
        place += place % 2
        starts = [place + sum(sizes[:i]) for i in range(len(sizes))] if len(sizes) < 64 else (place + np.concatenate(([0], np.cumsum(sizes)[:-1]))).tolist()
        entries = [_entry(at, big, starts, order) if e[0] == at else e for e in entries]
        stop = place + sum(sizes)
        stop += stop % 2
        out += struct.pack(order + ("Q" if how.bigtiff else "H"), len(entries))
        for tag, kind, n_values, raw in entries:
            out += struct.pack(order + "HH" + count, tag, kind, n_values)
            out += struct.pack(order + offset, room[tag]) if tag in room else raw.ljust(pad, b"\0")
        out += struct.pack(order + offset, stop if k + 1 < len(pages) else 0)
        for tag, _, _, raw in entries:
            if tag in room:
                out += bytes(room[tag] - len(out)) + raw
        out += bytes(place - len(out)) + b"".join(parts)
        out += bytes(stop - len(out))
    return bytes(out)


class Canvas:
    """One file's image, as its rows come."""

    def __init__(self, file: int, how: Layout) -> None:
        self.file, self.how, self.last = file, how, 0
        self.size = how.width * how.rows
        self.image, self.bits = np.zeros((self.size, how.bands), how.dtype), np.zeros((self.size, 1), bool)

    def add(self, b: pa.RecordBatch) -> None:
        if not b.num_rows:
            return
        at = b.column("key").to_numpy() - self.file * self.size
        values = b.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.how.bands)
        self.image[at] = values.astype(self.how.dtype)
        if self.how.mask:
            self.bits[at, 0] = b.column("masked").to_numpy(zero_copy_only=False)
        self.last = max(self.last, int(at.max()))

    def encoded(self) -> bytes:
        how, height = self.how, self.last // self.how.width + 1
        shaped = lambda x: x[: height * how.width].reshape(height, how.width, -1)
        return encoded(shaped(self.image), how, self.file * how.rows, shaped(self.bits) if how.mask else None)


def write(rows: DataFrame, folder: str, how: Layout) -> DataFrame:
    """Writes rows (key, values array, and masked boolean if the layout has a mask); returns file, bytes. Keys are 0 or more."""
    importable(rows.sparkSession)

    def one(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canvas = Canvas(key[0].as_py(), how)
        for b in it:
            canvas.add(b)
        data = canvas.encoded()
        write_file(folder, f"part-{canvas.file:08d}.tif", data)
        yield pa.RecordBatch.from_pydict({"file": [canvas.file], "bytes": [len(data)]})

    return rows.withColumn("file", F.floor(F.col("key") / (how.width * how.rows)).cast("bigint")).groupBy("file").applyInArrow(one, "file bigint, bytes bigint")
