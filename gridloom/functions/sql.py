"""The engine's functions for SQL text: `register(spark)`, then LATERAL raster_tags(content) and raster_decode(...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import Decoder, registry
from ..operators.decode import samples
from ..sources.scan import directories
from ..sources.storage import importable

TAGS = "ifd_idx int, tag int, type int, count bigint, longs array<bigint>, doubles array<double>, text string, unsigned array<decimal(20,0)>"
IFDS = "ifd_idx int, endianness string, bigtiff boolean, ifd_offset bigint, next_ifd_offset bigint, n_entries int"


class RasterTags:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for d in directories(lambda a, z: content[a:z]):
            for e in d["entries"]:
                yield d["ifd_idx"], e["tag"], e["type"], e["count"], e["longs"], e["doubles"], e["text"], e["unsigned"]


class RasterIfds:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for d in directories(lambda a, z: content[a:z]):
            yield d["ifd_idx"], d["endianness"], d["bigtiff"], d["ifd_offset"], d["next_ifd_offset"], len(d["entries"])


def register(spark: SparkSession, decoders: dict[int, Decoder] | None = None) -> None:
    """raster_tags(content), raster_ifds(content) as table functions; raster_decode(content, compression, predictor, dtype, height, width, samples, endianness) gives little-endian samples."""
    importable(spark)
    known = registry(decoders)
    spark.udtf.register("raster_tags", F.udtf(RasterTags, returnType=TAGS))
    spark.udtf.register("raster_ifds", F.udtf(RasterIfds, returnType=IFDS))

    @F.pandas_udf("binary")
    def raster_decode(content: pd.Series, compression: pd.Series, predictor: pd.Series, dtype: pd.Series, height: pd.Series, width: pd.Series, bands: pd.Series, endianness: pd.Series) -> pd.Series:
        out = []
        for c, code, p, kind, h, w, n, order in zip(content, compression, predictor, dtype, height, width, bands, endianness, strict=True):
            t = {"compression": int(code), "predictor": None if pd.isna(p) else int(p), "dtype": kind, "tile_height": int(h), "tile_width": int(w), "samples_per_pixel": int(n), "band": None, "endianness": order}
            a = samples(bytes(c), t, known)
            out.append(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes())
        return pd.Series(out, dtype=object)

    spark.udf.register("raster_decode", raster_decode)


def present(row: Row) -> dict:
    """The fields of a directory or geo-key row that have a value, as a mapping."""
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
