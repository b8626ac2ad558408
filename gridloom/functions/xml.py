"""Metadata that files hold as XML: GDAL's items and OME's images, as rows, and what they say of pixel values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GDAL = "Item array<struct<_name:string,_domain:string,_sample:string,_role:string,_VALUE:string>>"
_OME = (
    "Image array<struct<_ID:string,_Name:string,Pixels:struct<_Type:string,_DimensionOrder:string,_SizeX:string,_SizeY:string,_SizeZ:string,_SizeC:string,_SizeT:string,"
    "_PhysicalSizeX:string,_PhysicalSizeXUnit:string,_PhysicalSizeY:string,_PhysicalSizeYUnit:string,Channel:array<struct<_ID:string,_Name:string,_SamplesPerPixel:string>>,"
    "TiffData:array<struct<_IFD:string,_FirstZ:string,_FirstC:string,_FirstT:string,_PlaneCount:string>>>>>"
)


def gdal_items(text: Column | str = "gdal_metadata") -> Column:
    """An array of domain, item, sample, role, value. Null, empty and broken texts give no items; the default domain is ''."""
    items = F.coalesce(F.from_xml(text, _GDAL)["Item"], F.array())
    return F.transform(items, lambda i: F.struct(F.coalesce(i["_domain"], F.lit("")).alias("domain"), i["_name"].alias("item"), i["_sample"].try_cast("int").alias("sample"), i["_role"].alias("role"), i["_VALUE"].alias("value")))


def metadata(ifds: DataFrame) -> DataFrame:
    """path, ifd_idx, domain, item, sample, role, value: a row for each item of a directory's GDAL metadata."""
    return ifds.where("gdal_metadata is not null").select("path", "ifd_idx", F.inline(gdal_items()))


def calibrated(ifds: DataFrame) -> DataFrame:
    """ifds with nodata, scales and offsets: a double, and for each sample what the items of those roles say, else 1 and 0.

    An item without a sample holds for all of them that have none of their own; values that are no numbers count as absent.
    """
    out = ifds.withColumn("_items", gdal_items()).withColumn("nodata", F.trim("gdal_nodata").try_cast("double"))

    def each(role: str, other: float) -> Column:
        of = lambda test: F.filter("_items", lambda i: (F.lower(i["role"]) == role) & test(i["sample"]) & i["value"].try_cast("double").isNotNull())
        first = lambda test: F.try_element_at(of(test), F.lit(1))["value"].try_cast("double")
        n = F.greatest(F.coalesce("samples_per_pixel", F.lit(1).cast("bigint")), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(first(lambda s: s == k), first(lambda s: s.isNull()), F.lit(other)))

    return out.withColumn("scales", each("scale", 1.0)).withColumn("offsets", each("offset", 0.0)).drop("_items")


def physical(pixels: DataFrame) -> DataFrame:
    """Pixels that kept nodata, scales and offsets, with value times scale plus offset; those of nodata have no row. Nothing is joined."""
    at = lambda c: F.get(c, F.coalesce("band", F.lit(0)))
    seen = pixels.where(F.col("nodata").isNull() | (F.col("value") != F.col("nodata")))
    return seen.withColumn("value", F.col("value") * at("scales") + at("offsets")).drop("nodata", "scales", "offsets")


def _images(ifds: DataFrame) -> DataFrame:
    text = F.when(F.col("image_description").contains("<OME"), F.col("image_description"))
    each = ifds.select("path", "ifd_idx", text.alias("t")).where("t is not null")
    return each.select("path", "ifd_idx", F.posexplode(F.from_xml("t", _OME)["Image"]).alias("image", "i"))


def ome_images(ifds: DataFrame) -> DataFrame:
    """path, ifd_idx, image, id, name, type, order, the sizes and physical sizes: a row for each image of a directory's OME text."""
    p = F.col("i.Pixels")
    sizes = [p[f"_Size{d}"].try_cast("int").alias(f"size_{d.lower()}") for d in "XYZCT"]
    sides = [c for d in "XY" for c in (p[f"_PhysicalSize{d}"].try_cast("double").alias(f"physical_{d.lower()}"), p[f"_PhysicalSize{d}Unit"].alias(f"unit_{d.lower()}"))]
    return _images(ifds).select("path", "ifd_idx", "image", F.col("i._ID").alias("id"), F.col("i._Name").alias("name"), p["_Type"].alias("type"), p["_DimensionOrder"].alias("order"), *sizes, *sides)


def ome_channels(ifds: DataFrame) -> DataFrame:
    """path, ifd_idx, image, channel, id, name."""
    return _images(ifds).select("path", "ifd_idx", "image", F.posexplode("i.Pixels.Channel").alias("channel", "c")).select("path", "ifd_idx", "image", "channel", F.col("c._ID").alias("id"), F.col("c._Name").alias("name"))


def ome_planes(ifds: DataFrame) -> DataFrame:
    """path, ifd_idx, image, plane_ifd, first_z, first_c, first_t, plane_count: which directories hold an image's planes; absent numbers are 0, an absent count is 1."""
    each = _images(ifds).select("path", "ifd_idx", "image", F.explode("i.Pixels.TiffData").alias("t"))
    number = lambda c, other=0: F.coalesce(F.col(f"t.{c}").try_cast("int"), F.lit(other))
    return each.select("path", "ifd_idx", "image", number("_IFD").alias("plane_ifd"), number("_FirstZ").alias("first_z"), number("_FirstC").alias("first_c"), number("_FirstT").alias("first_t"), number("_PlaneCount", 1).alias("plane_count"))
