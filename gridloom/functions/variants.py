"""Values of any tag as VARIANT: cast by `variant_get` or `try_variant_get`, compared as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that say where a file keeps its pixels, which equal images need not have in common.
PLACES = (273, 279, 288, 289, 324, 325)


def as_variant(e: Column) -> Column:
    """An entry's value: text, a number for a single one, else an array of numbers; rationals are quotients, null over 0."""
    pairs = F.when(e["type"].isin(5, 10), F.transform(F.sequence(F.lit(0), F.greatest((F.size(e["longs"]) / 2).cast("int") - 1, F.lit(0))), lambda k: F.try_divide(F.get(e["longs"], k * 2).cast("double"), F.get(e["longs"], k * 2 + 1).cast("double"))))
    out = F.when(e["text"].isNotNull(), e["text"].cast("variant"))
    for numbers, count in ((pairs, e["count"]), (e["doubles"], F.size(e["doubles"])), (e["unsigned"], F.size(e["unsigned"])), (e["longs"], F.size(e["longs"]))):
        out = out.when(numbers.isNotNull() & (count == 1), F.get(numbers, F.lit(0)).cast("variant")).when(numbers.isNotNull(), F.to_variant_object(numbers))
    return out


def tag_values(tags: DataFrame) -> DataFrame:
    """path, ifd_idx, tag, tag_name, value of the relation tags: of a tag that a directory repeats the last entry."""
    last = Window.partitionBy("path", "ifd_idx", "tag").orderBy(F.col("tag_idx").desc())
    only = tags.withColumn("_k", F.row_number().over(last)).where("_k = 1")
    return only.select("path", "ifd_idx", "tag", "tag_name", as_variant(F.struct("type", "count", "longs", "doubles", "text", "unsigned")).alias("value"))


def other_values(other_tags: Column | str = "other_tags") -> Column:
    """The entries that are no field of ifds as a map of tag to value; of repeated tags the last. A projection, without a shuffle."""
    every = F.col(other_tags) if isinstance(other_tags, str) else other_tags
    later = lambda x: F.exists(every, lambda y: (y["tag"] == x["tag"]) & (y["tag_idx"] > x["tag_idx"]))
    return F.map_from_entries(F.transform(F.filter(every, lambda x: ~later(x)), lambda x: F.struct(x["tag"], as_variant(x))))


def differences(left: DataFrame, right: DataFrame, by: list[str], beside: tuple[int, ...] = PLACES) -> DataFrame:
    """by, tag, tag_name, left, right: tags whose values differ between directories that agree in the columns `by`, values as JSON; null where one has none.

    Both are tag_values, with the columns `by`, which name a directory on its side. Equal directories have no row. Tags
    `beside` don't count. One shuffle of each side, of a row for each tag.
    """
    own = lambda d, c: d.where(~F.col("tag").isin(*beside)).select(*by, "tag", "tag_name", F.to_json("value").alias(c))
    key = [*by, "tag", "tag_name"]
    return own(left, "left").join(own(right, "right"), key, "full").where(~F.col("left").eqNullSafe(F.col("right"))).select(*key, "left", "right")
