"""Rasters that arrive in a folder, as a stream of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.directories import ifds
from ..sources.scan import scan
from ..sources.storage import importable

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.tif", recursive: bool = False, **options: str) -> DataFrame:
    """The directories of each new file, once; files that don't parse come as rows with an error."""
    importable(spark)
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).options(**options).load(folder)
    return scan(spark, files.select("path", "length", "content"), mode="PERMISSIVE")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the directories of new files to a Parquet folder, exactly once, until none is left."""
    found = ifds(arriving(spark, folder), "PERMISSIVE").drop("other_tags")
    return found.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
