"""A handle on raster files, with the engine's relations as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import variants, xml
from ..operators import decode, directories, pyramid, tiles, zones
from ..operators.codecs import Decoder
from ..sources.scan import scan
from ..sources.storage import Read, importable, range_reader


class Raster:
    """`Raster.open(spark, path).tiles().where("ifd_idx = 0 and x < 4")`, then `decode` or `pixels` of those tiles.

    Filters stand before fetch and decode, so only the tiles that pass are read.
    """

    def __init__(self, scanned: DataFrame, reader: Callable[[str], Read] = range_reader, mode: str = "FAILFAST") -> None:
        self.scanned, self.reader, self.mode = scanned, reader, mode

    @classmethod
    def open(cls, spark: SparkSession, files: str | list[str] | DataFrame, prefetch: int = 32768, multiplier: float = 2.0, reader: Callable[[str], Read] = range_reader, mode: str = "FAILFAST") -> Raster:
        importable(spark)
        if not callable(reader):
            raise TypeError("reader takes a path and returns a function of start and stop")
        return cls(scan(spark, files, prefetch, multiplier, reader, mode), reader, mode)

    @cached_property
    def ifds(self) -> DataFrame:
        return directories.ifds(self.scanned, self.mode)

    @cached_property
    def tags(self) -> DataFrame:
        return directories.tags(self.scanned)

    @cached_property
    def files(self) -> DataFrame:
        return directories.files(self.ifds)

    @cached_property
    def palette(self) -> DataFrame:
        return directories.palette(self.ifds)

    @cached_property
    def errors(self) -> DataFrame:
        """path, ifd_idx, error: files or directories that don't parse, and fields that are null for a wrong entry."""
        bad = self.ifds.select("path", "ifd_idx", F.explode("bad_fields").alias("field")).select("path", "ifd_idx", F.concat(F.lit("field "), "field").alias("error"))
        return self.scanned.where("error is not null").select("path", F.col("ifd_idx"), "error").unionByName(bad)

    def ifd(self, path: str, idx: int) -> Row:
        """One directory, on the driver; rows of equal fields are equal. IndexError without it."""
        got = self.ifds.where((F.col("path") == path) & (F.col("ifd_idx") == idx)).take(1)
        if not got:
            raise IndexError(f"no directory {idx} in {path}")
        return got[0]

    def tiles(self, *keep: str) -> DataFrame:
        return tiles.tiles(self.ifds, *keep)

    @cached_property
    def values(self) -> DataFrame:
        """path, ifd_idx, tag, tag_name, value: each tag's value as VARIANT."""
        return variants.tag_values(self.tags)

    @cached_property
    def metadata(self) -> DataFrame:
        """The items of GDAL's metadata."""
        return xml.metadata(self.ifds)

    def calibrated_tiles(self, *keep: str) -> DataFrame:
        """Tiles with nodata, scales and offsets, for `physical`."""
        return tiles.tiles(xml.calibrated(self.ifds), "nodata", "scales", "offsets", *keep)

    def physical(self, chosen: DataFrame, keep: tuple[str, ...] = (), decoders: dict[int, Decoder] | None = None) -> DataFrame:
        """Pixels of calibrated tiles in the units of what they measure, without those of nodata."""
        return xml.physical(self.pixels(chosen, keep=("nodata", "scales", "offsets", *keep), decoders=decoders))

    def pyramid(self, chosen: DataFrame, levels: int | None = None, tile: int = 256, statistic: str = "mean", nodata: float | None = None) -> DataFrame:
        """The tiles of the reduced levels of some images."""
        return pyramid.pyramid(chosen, levels, tile, statistic, nodata, self.reader)

    def requested(self, wanted: list[tuple[str, int, int, int]] | DataFrame, decoders: dict[int, Decoder] | None = None) -> DataFrame:
        """The decoded tiles of requests (path, ifd_idx, x, y), with the ordinal of each; sort by it for their order.

        A list counts from 0; a DataFrame has a column ordinal. A tile that isn't there is an error, or with PERMISSIVE a row
        without data whose `error` says so. Tiles whose bands lie apart have a row for each band.
        """
        if not isinstance(wanted, DataFrame):
            rows = [(k, *w) for k, w in enumerate(wanted)]
            wanted = self.scanned.sparkSession.createDataFrame(rows, "ordinal long, path string, ifd_idx int, x int, y int")
        place = ["path", "ifd_idx", "x", "y"]
        found = tiles.ordered(self.tiles(), wanted, self.mode != "PERMISSIVE")
        there = found.where("missing is null").select("ordinal", *place, "band")
        # A tile that is asked for several times is read and decoded once.
        once = self.decode(self.tiles().join(there.select(*place).distinct(), place, "left_semi"), decoders)
        got = there.alias("t").join(once.alias("d"), [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*place, "band")]).select("t.ordinal", "d.*")
        none = found.where("missing is not null").select("ordinal", *place, "band", *(F.lit(None).cast(once.schema[c].dataType).alias(c) for c in ("dtype", "shape", "data")), F.col("missing").alias("error"))
        return got.unionByName(none)

    def fetch(self, chosen: DataFrame) -> DataFrame:
        return decode.fetch(chosen, self.reader)

    def decode(self, chosen: DataFrame, decoders: dict[int, Decoder] | None = None, mode: str | None = None) -> DataFrame:
        return decode.decode(chosen, decoders, self.reader, mode or self.mode)

    def pixels(self, chosen: DataFrame, value: str = "double", keep: tuple[str, ...] = (), decoders: dict[int, Decoder] | None = None, mode: str | None = None) -> DataFrame:
        return decode.pixels(chosen, value, keep, decoders, self.reader, mode or self.mode)

    def zones(self, chosen: DataFrame, nodata: float | None = None) -> DataFrame:
        """The zone map of some tiles, to be written and used again; it reads them all once."""
        return zones.zone_map(self.pixels(chosen, keep=("x", "y"), mode="FAILFAST"), nodata)

    def pixels_between(self, chosen: DataFrame, index: DataFrame, low: float | None = None, high: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """The pixels with values from low to high; only tiles that the index doesn't rule out are read."""
        return zones.between(self.pixels(zones.matching(chosen, index, low, high), keep=keep, mode="FAILFAST"), low, high)

    def views(self, prefix: str = "raster") -> None:
        """Temporary views of the relations, for SQL."""
        for name, relation in (("files", self.files), ("ifds", self.ifds), ("tags", self.tags), ("tiles", self.tiles())):
            relation.createOrReplaceTempView(f"{prefix}_{name}")
