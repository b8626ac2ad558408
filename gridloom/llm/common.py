"""Helpers that several operators share: shared folders, global order, sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import delete, importable, shared_path

__all__ = ["bounded", "delete", "done_with", "importable", "packed", "partitions", "ranged", "recorded", "running_sum", "shared_path", "table", "written"]

#: A table is broadcast only after its rows and bytes were counted and are at most this many.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Rows of narrow tables that one file is worth.
FILE_ROWS = 20_000

#: Where the tables that are being made are noted, if they are: see recorded.
_noted: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile, so that they can be deleted once no plan reads them."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.remove(paths)


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df as a table in the shared folder: later plans start there, on any executor.

    A table of at most `most` rows has a file for each core, or for each FILE_ROWS if they are more, however many
    partitions it comes from: on a local file system Hadoop may start processes for each new file.
    """
    if most is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
    path = shared_path(df.sparkSession, name)
    for paths in _noted:
        paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t.written_at)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and all columns as one struct `row`, so that no further column can clash with them."""
    return docs.select(*names, F.struct("*").alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and their bytes, both counted, are at most so many; else Spark shuffles it.

    df should be cheap to read: a written table or an aggregate of one.
    """
    n, held = df.agg(F.count("*"), F.sum(sum((_bytes(f) for f in df.schema), F.lit(0)))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def ranged(df: DataFrame, *order: Column, name: str = "ranged") -> DataFrame:
    """df sorted over the whole cluster: written with _part, the number of its range."""
    spark = df.sparkSession
    return written(df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), name)


def running_sum(df: DataFrame, value: str, *order: Column, out: str = "running") -> DataFrame:
    """The sum of `value` up to and with each row in the global order, without a one-task window.

    Rows are range-sorted, summed inside each range, and moved up by the sums of
    the ranges before; that last table has a row for each range only.
    """
    parts = ranged(df, *order)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "_part").withColumn(out, own + F.col("_before")).drop("_part", "_before")
