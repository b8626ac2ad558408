"""Scan of TIFF, BigTIFF and GeoTIFF metadata: a row for each image directory, without pixel data."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import CycleError, FormatError
from .storage import Read, ReadAhead, closed, range_reader

# Field types of the TIFF 6.0 and BigTIFF specifications, and their numpy kinds.
KINDS = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
PAIRED = (5, 10)

ENTRY = "struct<tag_idx:int,tag:int,type:int,count:bigint,longs:array<bigint>,doubles:array<double>,text:string,unsigned:array<decimal(20,0)>>"
SCAN = f"path string, length bigint, endianness string, bigtiff boolean, ifd_idx int, ifd_offset bigint, next_ifd_offset bigint, entries array<{ENTRY}>, error string"
_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("length", pa.int64()), ("endianness", pa.string()), ("bigtiff", pa.bool_()), ("ifd_idx", pa.int32()), ("ifd_offset", pa.int64()), ("next_ifd_offset", pa.int64()),
        ("entries", pa.list_(pa.struct([("tag_idx", pa.int32()), ("tag", pa.int32()), ("type", pa.int32()), ("count", pa.int64()), ("longs", pa.list_(pa.int64())), ("doubles", pa.list_(pa.float64())), ("text", pa.string()), ("unsigned", pa.list_(pa.decimal128(20, 0)))]))),
        ("error", pa.string()),
    ]
)


def header(read: Read) -> tuple[str, bool, int]:
    """Byte order, whether it is BigTIFF, and the first directory's offset."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise FormatError("no TIFF byte order mark")
    version = struct.unpack_from(order + "H", head, 2)[0]
    if version == 42:
        return order, False, struct.unpack_from(order + "I", head, 4)[0]
    if version == 43 and len(head) == 16:
        size, zero, first = struct.unpack_from(order + "HHQ", head, 4)
        if size == 8 and zero == 0:
            return order, True, first
    raise FormatError(f"no TIFF header: version {version}")


def value(raw: bytes, kind: int, order: str) -> dict:
    """An entry's bytes as numbers or text. Text ends at its first NUL; rationals are numerator, denominator.

    Numbers of 2^63 and more, which no bigint holds, are in `unsigned` with all others of their entry.
    """
    out: dict = dict.fromkeys(("longs", "doubles", "text", "unsigned"))
    if kind == 2:
        return out | {"text": raw.split(b"\0")[0].decode("utf-8", "replace")}
    numbers = np.frombuffer(raw, order + KINDS[kind])
    if kind in (11, 12):
        return out | {"doubles": numbers.astype("f8").tolist()}
    if numbers.dtype.kind == "u" and numbers.itemsize == 8 and len(numbers) and int(numbers.max()) >> 63:
        return out | {"unsigned": [Decimal(x) for x in numbers.tolist()]}
    return out | {"longs": numbers.astype("i8").tolist()}


def directories(read: Read) -> Iterator[dict]:
    """The directories of one file in the order they are chained."""
    order, big, at = header(read)
    number, entry, inline, count_kind = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise CycleError(f"directory at {at} comes again")
        seen.add(at)
        width = struct.calcsize(order + number)
        if len(raw := read(at, at + width)) < width:
            raise FormatError(f"directory at {at} is beyond the end")
        n = struct.unpack(order + number, raw)[0]
        table = read(at + width, at + width + n * entry + inline)
        if len(table) < n * entry + inline:
            raise FormatError(f"directory at {at} is cut off")
        entries = []
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", table, k * entry)
            count = struct.unpack_from(order + count_kind, table, k * entry + 4)[0]
            if kind not in KINDS:
                continue  # readers skip field types that they don't know
            size = np.dtype(KINDS[kind]).itemsize * count * (2 if kind in PAIRED else 1)
            place = k * entry + entry - inline
            if size <= inline:
                raw = table[place : place + size]
            else:
                start = struct.unpack_from(order + ("Q" if big else "I"), table, place)[0]
                raw = read(start, start + size)
                if len(raw) < size:
                    raise FormatError(f"value of tag {tag} is beyond the end")
            entries.append({"tag_idx": k, "tag": tag, "type": kind, "count": count} | value(raw, kind, order))
        after = struct.unpack_from(order + ("Q" if big else "I"), table, n * entry)[0]
        yield {"endianness": "little" if order == "<" else "big", "bigtiff": big, "ifd_idx": len(seen) - 1, "ifd_offset": at, "next_ifd_offset": after or None, "entries": entries, "error": None}
        at = after


def scan(spark: SparkSession, files: str | list[str] | DataFrame, prefetch: int = 32768, multiplier: float = 2.0, reader: Callable[[str], Read] = range_reader, mode: str = "FAILFAST") -> DataFrame:
    """A row for each directory of the files: a path, a glob, http(s) addresses, or a DataFrame of path, length and perhaps content.

    Only headers and directories are read, by ranges. With a content column no file
    is opened, which serves stores that only Spark reads and rows that arrive by
    stream. PERMISSIVE gives what was read up to an error and then a row with the error.
    """
    if not isinstance(files, DataFrame):
        every = [files] if isinstance(files, str) else list(files)
        urls = [f for f in every if f.startswith(("http://", "https://"))]
        rest = [f for f in every if f not in urls]
        addressed = spark.createDataFrame([(u, None) for u in urls], "path string, length bigint")
        # A listing has one row for each file; http servers give none.
        listed = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(rest).select("path", "length")] if rest else []
        files = addressed if not listed else listed[0].unionByName(addressed) if urls else listed[0]
    held = "content" in files.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for k, path in enumerate(b.column("path").to_pylist()):
                facts = {"path": path, "length": b.column("length")[k].as_py()}
                try:
                    if held:
                        data = b.column("content")[k].as_py() or b""
                        rows += [facts | d for d in directories(lambda a, z, data=data: data[a:z])]
                    else:
                        source = reader(path)
                        rows += [facts | d for d in directories(ReadAhead(source, prefetch, multiplier))]
                        closed(source)
                except (FormatError, OSError) as e:
                    if mode != "PERMISSIVE":
                        raise
                    rows.append(facts | dict.fromkeys(("endianness", "bigtiff", "ifd_idx", "ifd_offset", "next_ifd_offset", "entries")) | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select("path", "length", *(["content"] if held else [])).mapInArrow(run, SCAN)
