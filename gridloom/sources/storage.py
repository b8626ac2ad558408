"""Folders and byte ranges that every executor can reach."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.request import Request, urlopen

from pyarrow import fs
from pyspark.sql import SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors see; only a local session without it gets a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if not where:
        if known.isDefined():
            return known.get()
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        where = tempfile.mkdtemp(prefix="gridloom-")
    if known.isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


@atexit.register
def _delete_scratch() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder then stays
            return


def importable(spark: SparkSession) -> None:
    """Let this machine's Python workers import this package; clusters use addPyFile."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark spells it (file, hdfs, s3a, gs, abfss)."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all. A retried task makes the same bytes, so a file that is there already stays."""
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    part, whole = f"{path}/_{name}.{uuid.uuid4().hex}", f"{path}/{name}"
    with where.open_output_stream(part) as out:
        out.write(data)
    try:
        where.move(part, whole)
    except OSError:
        if where.get_file_info(whole).type != fs.FileType.File:
            raise
        where.delete_file(part)


#: Reads bytes start..stop of one file; fewer at its end. It may have `size`, `close()` and `many(ranges)`, which answers several ranges at once.
Read = Callable[[int, int], bytes]


class FileRanges:
    """Ranges of a file in a store that pyarrow opens."""

    def __init__(self, path: str) -> None:
        where, inner = opened(path)
        self.source = where.open_input_file(inner)
        self.size = self.source.size()

    def __call__(self, start: int, stop: int) -> bytes:
        return self.source.read_at(max(0, min(stop, self.size) - start), start) if start < self.size else b""

    def close(self) -> None:
        self.source.close()


class HttpRanges:
    """Ranges of a file behind http or https, by the Range header; servers that ignore it are asked once for all."""

    def __init__(self, url: str, timeout: float = 60.0) -> None:
        self.url, self.timeout, self.whole = url, timeout, None

    def __call__(self, start: int, stop: int) -> bytes:
        if stop <= start:
            return b""
        if self.whole is None:
            try:
                with urlopen(Request(self.url, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=self.timeout) as got:
                    if got.status == 206:
                        return got.read()
                    self.whole = got.read()
            except OSError as e:
                if getattr(e, "code", None) == 416:  # the range begins behind the end
                    return b""
                raise
        return self.whole[start:stop]


def range_reader(path: str) -> Read:
    """The default backend. A user's own takes a path and returns such a function."""
    return HttpRanges(path) if re.match("https?://", path) else FileRanges(path)


def closed(read: Read) -> None:
    getattr(read, "close", lambda: None)()


class ReadAhead:
    """The first bytes of a file, fetched in growing blocks as metadata asks for them.

    The first block has `prefetch` bytes; each further one is the length so far
    times `multiplier`, and at least what was asked for.
    """

    def __init__(self, read: Read, prefetch: int = 32768, multiplier: float = 2.0) -> None:
        self.read, self.prefetch, self.multiplier = read, prefetch, multiplier
        self.held, self.fetches = bytearray(), 0

    def __call__(self, start: int, stop: int) -> bytes:
        while stop > (n := len(self.held)):
            want = max(round(n * self.multiplier) if n else self.prefetch, stop - n)
            got = self.read(n, n + want)
            self.fetches += 1
            self.held += got
            if len(got) < want:
                break
        return bytes(self.held[start:stop])
