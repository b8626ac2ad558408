"""GeoTIFF keys in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import entry

# GeoTIFF key ids, by the type of their values.
INTS = {
    1024: "model_type", 1025: "raster_type", 2048: "geographic_type", 2050: "geog_geodetic_datum", 2051: "geog_prime_meridian", 2052: "geog_linear_units",
    2054: "geog_angular_units", 2056: "geog_ellipsoid", 2060: "geog_azimuth_units", 3072: "projected_type", 3074: "projection", 3075: "proj_coord_trans",
    3076: "proj_linear_units", 4096: "vertical", 4098: "vertical_datum", 4099: "vertical_units",
}
STRINGS = {1026: "citation", 2049: "geog_citation", 3073: "proj_citation", 4097: "vertical_citation"}
DOUBLES = {
    2053: "geog_linear_unit_size", 2055: "geog_angular_unit_size", 2057: "geog_semi_major_axis", 2058: "geog_semi_minor_axis", 2059: "geog_inv_flattening",
    2061: "geog_prime_meridian_long", 3077: "proj_linear_unit_size", 3078: "proj_std_parallel1", 3079: "proj_std_parallel2", 3080: "proj_nat_origin_long",
    3081: "proj_nat_origin_lat", 3082: "proj_false_easting", 3083: "proj_false_northing", 3084: "proj_false_origin_long", 3085: "proj_false_origin_lat",
    3086: "proj_false_origin_easting", 3087: "proj_false_origin_northing", 3088: "proj_center_long", 3089: "proj_center_lat", 3090: "proj_center_easting",
    3091: "proj_center_northing", 3092: "proj_scale_at_nat_origin", 3093: "proj_scale_at_center", 3094: "proj_azimuth_angle", 3095: "proj_straight_vert_pole_long",
}


def well_formed(entries: Column | str) -> Column:
    """Whether the key directory is an array of whole keys, as many as it promises; null without one."""
    e = entry(entries, 34735)
    keys = e["longs"]
    return F.when(e.isNotNull(), F.coalesce((F.size(keys) >= 4) & (F.get(keys, F.lit(3)) * 4 + 4 <= F.size(keys)), F.lit(False)))


def geo_keys(entries: Column | str, strict: bool = True) -> Column:
    """A struct of the known keys, null without a directory of version 1, revision 1.

    A key's value is in the directory itself, or a stretch of the double or the
    text parameters; a text ends without its closing bar. A directory that is shorter than
    it says is an error, or unless strict null.
    """
    keys = entry(entries, 34735)["longs"]
    doubles, text = entry(entries, 34736)["doubles"], entry(entries, 34737)["text"]
    n = F.greatest(F.lit(0), F.least(F.get(keys, F.lit(3)).cast("int"), F.floor(F.size(keys) / 4).cast("int") - 1))
    part = lambda i, k: F.get(keys, (i * 4 + k).cast("int"))
    one = lambda i: F.struct(part(i, 0).alias("id"), part(i, 1).alias("where"), part(i, 2).cast("int").alias("n"), part(i, 3).cast("int").alias("v"))
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one))
    found = lambda k, where: F.try_element_at(F.filter(rows, lambda r: (r["id"] == k) & (r["where"] == where)), F.lit(1))
    ints = [found(k, 0)["v"].alias(name) for k, name in INTS.items()]
    strings = [F.regexp_replace(F.substring(text, found(k, 34737)["v"] + 1, found(k, 34737)["n"]), r"\|$", "").alias(name) for k, name in STRINGS.items()]
    floats = [F.get(doubles, found(k, 34736)["v"]).alias(name) for k, name in DOUBLES.items()]
    struct = F.struct(*ints, *strings, *floats)
    valid = (F.get(keys, F.lit(0)) == 1) & (F.get(keys, F.lit(1)) == 1) & (n > 0)
    bad = F.raise_error(F.lit("the geo key directory is cut off")) if strict else F.lit(None)
    fine = well_formed(entries)
    return F.when(fine & valid, struct).when(fine.isNotNull() & ~fine, bad.cast(T.StructType([*(T.StructField(x, T.IntegerType()) for x in INTS.values()), *(T.StructField(x, T.StringType()) for x in STRINGS.values()), *(T.StructField(x, T.DoubleType()) for x in DOUBLES.values())])))


def epsg(keys: Column | str) -> Column:
    keys = F.col(keys) if isinstance(keys, str) else keys
    return F.coalesce(keys["projected_type"], keys["geographic_type"])
