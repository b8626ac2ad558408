"""The relations files, tags and ifds over a scan. All of it is projection; nothing is shuffled but for `files`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import epsg, geo_keys, well_formed
from ..functions.names import COMPRESSION, PHOTOMETRIC, TAGS, named
from ..functions.values import entry, number, numbers, pixel_type, rational, text

# Tag numbers of the fields by kind.
SINGLE = {
    "new_subfile_type": (254, "u32"), "image_width": (256, "u32"), "image_height": (257, "u32"), "orientation": (274, "u16"), "samples_per_pixel": (277, "u16"),
    "rows_per_strip": (278, "u32"), "tile_width": (322, "u32"), "tile_height": (323, "u32"),
}
LISTS = {
    "bits_per_sample": (258, "u16"), "strip_offsets": (273, "u64"), "strip_byte_counts": (279, "u64"), "min_sample_value": (280, "u16"), "max_sample_value": (281, "u16"),
    "colormap": (320, "u16"), "tile_offsets": (324, "u64"), "tile_byte_counts": (325, "u64"), "extra_samples": (338, "u16"), "model_pixel_scale": (33550, "f64"),
    "model_tiepoint": (33922, "f64"), "model_transformation": (34264, "f64"), "lerc_parameters": (50674, "u32"),
}
TEXTS = {
    "document_name": 269, "image_description": 270, "software": 305, "date_time": 306, "artist": 315, "host_computer": 316, "copyright": 33432, "gdal_nodata": 42113, "gdal_metadata": 42112,
}
CODES = {"compression": 259, "photometric_interpretation": 262, "planar_configuration": 284, "resolution_unit": 296, "predictor": 317}
REQUIRED = ("image_width", "image_height", "bits_per_sample", "photometric_interpretation", "samples_per_pixel")


def tags(scanned: DataFrame) -> DataFrame:
    """path, ifd_idx, tag_idx, tag, tag_name, type, count, longs, doubles, text, unsigned: a row for each entry."""
    each = scanned.where("error is null").select("path", "ifd_idx", F.explode("entries").alias("e")).select("path", "ifd_idx", "e.*")
    return each.withColumn("tag_name", named("tag", TAGS))


def ifds(scanned: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """A row for each directory with its typed fields and their defaults; unknown codes keep their number, or null where the field has no such value.

    An entry of a wrong type, count or range fails the query; with PERMISSIVE its field is null and its name stands in `bad_fields`.
    """
    e, strict = lambda tag: entry("entries", tag), mode != "PERMISSIVE"
    known = lambda code, codes: F.when(code.isin(*codes), code)
    first = scanned.where("error is null")
    one, many = (lambda tag, kind: number(e(tag), kind, strict)), (lambda tag, kind: numbers(e(tag), kind, strict))
    read = {k: (tag, one(tag, kind)) for k, (tag, kind) in SINGLE.items()} | {k: (tag, many(tag, kind)) for k, (tag, kind) in LISTS.items()} | {k: (tag, text(e(tag), strict)) for k, tag in TEXTS.items()}
    read |= {k: (tag, one(tag, "u16")) for k, tag in CODES.items()} | {"sample_format": (339, many(339, "u16")), "jpeg_tables": (347, many(347, "u8"))}
    got = {k: c for k, (_, c) in read.items()}
    fields = got | {
        "compression": F.coalesce(got["compression"], F.lit(1).cast("bigint")),
        "photometric_interpretation": known(got["photometric_interpretation"], PHOTOMETRIC),
        "planar_configuration": F.coalesce(known(got["planar_configuration"], (1, 2)), F.lit(1).cast("bigint")),
        "resolution_unit": known(got["resolution_unit"], (1, 2, 3)),
        "predictor": known(got["predictor"], (1, 2, 3)),
        "x_resolution": rational(e(282), strict),
        "y_resolution": rational(e(283), strict),
        "sample_format": F.coalesce(got["sample_format"], F.array_repeat(F.lit(1).cast("bigint"), F.coalesce(got["samples_per_pixel"], F.lit(1).cast("bigint")).cast("int"))),
        "geo_key_directory": geo_keys("entries", strict),
        "other_tags": F.filter("entries", lambda x: ~x["tag"].isin(*OWN)),
    }
    bad = [F.when(e(tag).isNotNull() & c.isNull(), F.lit(k)) for k, (tag, c) in read.items()] + [F.when(e(tag).isNotNull() & ~e(tag)["type"].isin(5, 10), F.lit(k)) for k, tag in (("x_resolution", 282), ("y_resolution", 283))]
    bad.append(F.when(~well_formed("entries"), F.lit("geo_key_directory")))
    fields["bad_fields"] = F.array_compact(F.array(*bad)) if not strict else F.array().cast("array<string>")
    out = first.select("path", "length", "endianness", "bigtiff", "ifd_idx", "ifd_offset", "next_ifd_offset", *(c.alias(k) for k, c in fields.items()))
    missing = F.filter(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED)), lambda x: x.isNotNull())
    return out.withColumn("missing", missing).withColumns(
        {
            "compression_name": named("compression", COMPRESSION),
            "dtype": pixel_type(F.col("sample_format"), F.col("bits_per_sample"), half=True),
            "epsg": epsg("geo_key_directory"),
            "taken_at": F.try_to_timestamp("date_time", F.lit("yyyy:MM:dd HH:mm:ss")),
        }
    )


OWN = {t for t, _ in (SINGLE | LISTS).values()} | set(TEXTS.values()) | set(CODES.values()) | {282, 283, 339, 347, 34735, 34736, 34737}


def files(directories: DataFrame) -> DataFrame:
    """path, length, endianness, bigtiff, ifd_count, header_byte_size: the least offset over 0 of pixel data."""
    offsets = F.concat(F.coalesce("tile_offsets", F.array().cast("array<bigint>")), F.coalesce("strip_offsets", F.array().cast("array<bigint>")))
    least = F.array_min(F.filter(offsets, lambda x: x > 0))
    return directories.withColumn("_least", least).groupBy("path", "length", "endianness", "bigtiff").agg(F.count("*").cast("int").alias("ifd_count"), F.min("_least").alias("header_byte_size"))


def palette(directories: DataFrame) -> DataFrame:
    """path, ifd_idx, value, red, green, blue: a row for each entry of a colormap, whose parts stand one after another."""
    n = (F.size("colormap") / 3).cast("int")
    at = directories.where("colormap is not null").select("path", "ifd_idx", "colormap", n.alias("n"), F.posexplode(F.slice("colormap", F.lit(1), n)).alias("value", "red"))
    return at.select("path", "ifd_idx", "value", "red", F.element_at("colormap", F.col("value") + F.col("n") + 1).alias("green"), F.element_at("colormap", F.col("value") + 2 * F.col("n") + 1).alias("blue"))
