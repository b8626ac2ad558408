"""`raster_tags` and `raster_tiles`: directories of files, and their tiles, as Python data sources with pushed filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.decode import islands
from .scan import directories
from .storage import ReadAhead, closed, opened, range_reader

COLUMNS = "path string, ifd_idx int, tag int, type int, count bigint, longs array<bigint>, doubles array<double>, text string, unsigned array<decimal(20,0)>"


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class TagReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.only, self.ifd = options, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on path and ifd_idx is met here, before files are opened; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("ifd_idx",):
                self.ifd = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, path = opened(self.options["path"])
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        names = sorted(x.path for x in found if not x.base_name.startswith(("_", ".")))
        return [File(p) for p in names if self.only in (None, p)]

    def read(self, partition: File) -> Iterator[tuple]:
        source = ReadAhead(range_reader(partition.path), int(self.options.get("prefetch", 32768)), float(self.options.get("multiplier", 2.0)))
        for d in directories(source):
            if self.ifd not in (None, d["ifd_idx"]):
                continue
            for e in d["entries"]:
                yield partition.path, d["ifd_idx"], e["tag"], e["type"], e["count"], e["longs"], e["doubles"], e["text"], e["unsigned"]


class RasterTags(DataSource):
    """Register with `spark.dataSource.register(RasterTags)`, with spark.sql.python.filterPushdown.enabled set."""

    @classmethod
    def name(cls) -> str:
        return "raster_tags"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> TagReader:
        return TagReader(self.options)


TILES = "path string, ifd_idx int, x int, y int, band int, start bigint, stop bigint, endianness string, image_width bigint, image_height bigint, tile_width bigint, tile_height bigint, samples_per_pixel bigint, compression bigint, predictor bigint, dtype string, jpeg_tables array<bigint>, lerc_parameters array<bigint>, model_tiepoint array<double>, model_pixel_scale array<double>, content binary"
_TILES = pa.schema(
    [("path", pa.string()), *((c, pa.int32()) for c in ("ifd_idx", "x", "y", "band")), ("start", pa.int64()), ("stop", pa.int64()), ("endianness", pa.string())]
    + [(c, pa.int64()) for c in ("image_width", "image_height", "tile_width", "tile_height", "samples_per_pixel", "compression", "predictor")]
    + [("dtype", pa.string()), *((c, pa.list_(pa.int64())) for c in ("jpeg_tables", "lerc_parameters")), *((c, pa.list_(pa.float64())) for c in ("model_tiepoint", "model_pixel_scale")), ("content", pa.binary())]
)
#: Comparisons that are met before any tile is read.
MEETS = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}


class Stretch(InputPartition):
    """Some files, or the tiles of one that begin in a stretch of it."""

    def __init__(self, paths: list[str], start: int = 0, stop: int = 1 << 62) -> None:
        self.paths, self.start, self.stop = paths, start, stop


def packed(files: list[tuple[str, int]], most: int) -> list[Stretch]:
    """Files by path and size as partitions of about `most` bytes: small ones together, large ones in stretches."""
    out, held, size = [], [], 0
    for path, n in files:
        if n > most:
            out += [Stretch([path], at, min(at + most, n)) for at in range(0, n, most)]
            continue
        if held and size + n > most:
            out.append(Stretch(held))
            held, size = [], 0
        held, size = [*held, path], size + n
    return [*out, Stretch(held)] if held else out


def kind_of(formats: list[int], bits: list[int]) -> str | None:
    """The samples' type, if they have one and the same."""
    if len({*formats}) != 1 or len({*bits}) != 1:
        return None
    kind, width = formats[0], bits[0]
    if kind == 1 and width == 1:
        return "bool"
    name = {1: "uint", 2: "int", 3: "float"}.get(kind)
    return f"{name}{width}" if name and width in ((16, 32, 64) if kind == 3 else (8, 16, 32, 64)) else None


def tiles_of(path: str, directory: dict) -> Iterator[dict]:
    """The tiles of a directory, as the relation `tiles` has them."""
    held = {e["tag"]: e["longs"] or e["doubles"] for e in directory["entries"]}
    one = lambda tag, other=None: held[tag][0] if held.get(tag) else other
    width, height, tw, th = one(256), one(257), one(322), one(323)
    if not all((width, height, tw, th, held.get(324), held.get(325))):
        return
    samples, across, down = one(277, 1), -(-width // tw), -(-height // th)
    facts = {
        "path": path, "ifd_idx": directory["ifd_idx"], "endianness": directory["endianness"], "image_width": width, "image_height": height, "tile_width": tw, "tile_height": th, "samples_per_pixel": samples,
        "compression": one(259, 1), "predictor": one(317), "dtype": kind_of(held.get(339) or [1], held.get(258) or [1]), "jpeg_tables": held.get(347), "lerc_parameters": held.get(50674), "model_tiepoint": held.get(33922), "model_pixel_scale": held.get(33550),
    }
    apart = one(284, 1) == 2
    for k, (start, n) in enumerate(zip(held[324], held[325], strict=False)):
        band, place = divmod(k, across * down)
        if band < (samples if apart else 1):
            yield facts | {"x": place % across, "y": place // across, "band": band if apart else None, "start": start, "stop": start + n}


class TileReader(DataSourceReader):
    KEYS = ("path", "ifd_idx", "x", "y")

    def __init__(self, options: dict) -> None:
        self.options, self.met = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of path, ifd_idx, x and y with values are met here: of the path before files are opened, of the others before tiles are read."""
        for f in filters:
            if type(f) in MEETS and len(f.attribute) == 1 and f.attribute[0] in self.KEYS:
                self.met.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, **values: object) -> bool:
        return all(MEETS[kind](values[c], v) for c, kind, v in self.met if c in values)

    def partitions(self) -> list[InputPartition]:
        where, path = opened(self.options["path"])
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        files = sorted((x.path, x.size) for x in found if not x.base_name.startswith(("_", ".")) and self.wanted(path=x.path))
        return packed(files, int(self.options.get("bytes", 32 << 20))) or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with_content = self.options.get("content", "true").lower() != "false"
        for path in partition.paths:
            source = range_reader(path)
            for d in directories(ReadAhead(source, int(self.options.get("prefetch", 32768)), float(self.options.get("multiplier", 2.0)))):
                if not self.wanted(ifd_idx=d["ifd_idx"]):
                    continue
                own = [t for t in tiles_of(path, d) if partition.start <= t["start"] < partition.stop and self.wanted(x=t["x"], y=t["y"])]
                for a, z, members in islands([(t["start"], t["stop"]) for t in own]):
                    data = source(a, z) if with_content else None
                    yield pa.RecordBatch.from_pylist([own[m] | {"content": data[own[m]["start"] - a : own[m]["stop"] - a] if with_content else None} for m in members], _TILES)
            closed(source)


class RasterTiles(DataSource):
    """`raster_tiles`: compressed tiles with all that decoding needs. Options: path, bytes (of a partition), content (false leaves tiles unread), prefetch, multiplier.

    Register with `spark.dataSource.register(RasterTiles)`, with spark.sql.python.filterPushdown.enabled set.
    Spark keeps the filters that it pushed last in a loaded DataFrame: load it anew for another query.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)
