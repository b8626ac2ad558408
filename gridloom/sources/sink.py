"""`raster`: a sink that writes rows as rasters, all of a job's files or none.

Tasks write into a staging folder beside the result; the commit moves what the
successful attempts have told, and an abort deletes the folder. Files of failed or
repeated attempts are never moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import FormatError
from .raster_writer import Canvas, Layout
from .storage import importable, opened

_PARSE = {"int": int, "float": float, "str": str, "bool": lambda text: text.strip().lower() in ("true", "1", "yes")}


def layout_of(options: dict) -> Layout:
    """A layout from options named as its fields; colormap and extra can't be given so."""
    held = {k.lower(): v for k, v in options.items()}
    if "dtype" not in held:
        raise ValueError("the option dtype is missing")
    return Layout(**{f.name: _PARSE[f.type](held[f.name]) for f in fields(Layout) if f.name in held and f.type in _PARSE})


def arranged(rows: DataFrame, how: Layout) -> DataFrame:
    """Rows (key, values, perhaps masked) shuffled so that a file's are together and in order, as the sink needs them."""
    importable(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.floor(F.col("key") / (how.width * how.rows))).sortWithinPartitions("key")


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # final name, staged name


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.how, self.overwrite = layout_of(options), overwrite
        self.folder = options["path"].rstrip("/")
        self.staging = f"{self.folder}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, staging = opened(self.staging)
        where.create_dir(staging, recursive=True)
        a_file, done, canvas = self.how.width * self.how.rows, {}, None

        def put(c: Canvas) -> None:
            name, staged = f"part-{c.file:08d}.tif", f"{staging}/{uuid.uuid4().hex}.tif"
            with where.open_output_stream(staged) as out:
                out.write(c.encoded())
            done[c.file] = (name, staged)

        for b in iterator:
            numbers = b.column("key").to_numpy() // a_file
            cuts = [0, *(k for k in range(1, len(numbers)) if numbers[k] != numbers[k - 1]), len(numbers)] if len(numbers) else []
            for a, z in zip(cuts, cuts[1:], strict=False):
                file = int(numbers[a])
                if canvas is None or canvas.file != file:
                    if canvas is not None:
                        put(canvas)
                    if file in done:
                        raise FormatError(f"the rows of file {file} aren't together: use arranged()")
                    canvas = Canvas(file, self.how)
                canvas.add(b.slice(a, z - a))
        if canvas is not None:
            put(canvas)
        return Staged(list(done.values()))

    def commit(self, messages: list[Staged | None]) -> None:
        where, folder = opened(self.folder)
        told = [f for m in messages if m for f in m.files]
        names = [name for name, _ in told]
        if len({*names}) < len(names):
            raise FormatError("the rows of a file came in several partitions: use arranged()")
        where.create_dir(folder, recursive=True)
        old = {x.base_name: x.path for x in where.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and x.base_name.endswith(".tif")}
        if not self.overwrite and (both := sorted({*names} & {*old})):
            raise FileExistsError(f"{both[0]} is there already")
        for path in old.values() if self.overwrite else ():
            where.delete_file(path)
        for name, staged in told:
            where.move(staged, f"{folder}/{name}")
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        where, staging = opened(self.staging)
        if where.get_file_info(staging).type == fs.FileType.Directory:
            where.delete_dir(staging)


class Rasters(DataSource):
    """`raster`, for writing: `arranged(rows, how).write.format("raster").option("path", ...).option("dtype", "uint8").mode("append").save()`.

    Options are named as the fields of Layout. append fails if a file of that name is there; overwrite replaces all rasters
    of the folder. No rows write no file. Register with `spark.dataSource.register(Rasters)`.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "key bigint, values array<double>"

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)
