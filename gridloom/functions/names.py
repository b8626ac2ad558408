"""Names of coded values, as lookups in SQL."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the TIFF 6.0 specification and its registered extensions.
COMPRESSION = {
    1: "none", 2: "huffman", 3: "fax3", 4: "fax4", 5: "lzw", 6: "old_jpeg", 7: "jpeg", 8: "deflate", 32773: "packbits", 32946: "old_deflate",
    34712: "jpeg2000", 34887: "lerc", 34925: "lzma", 50000: "zstd", 50001: "webp",
}
PHOTOMETRIC = {0: "white_is_zero", 1: "black_is_zero", 2: "rgb", 3: "palette", 4: "transparency_mask", 5: "cmyk", 6: "ycbcr", 8: "cielab"}
PLANAR = {1: "chunky", 2: "planar"}
PREDICTOR = {1: "none", 2: "horizontal", 3: "floating_point"}
RESOLUTION_UNIT = {1: "none", 2: "inch", 3: "centimeter"}
SAMPLE_FORMAT = {1: "uint", 2: "int", 3: "float", 4: "void"}
EXTRA_SAMPLES = {0: "unspecified", 1: "associated_alpha", 2: "unassociated_alpha"}
TAGS = {
    254: "new_subfile_type", 255: "subfile_type", 256: "image_width", 257: "image_height", 258: "bits_per_sample", 259: "compression",
    262: "photometric_interpretation", 266: "fill_order", 269: "document_name", 270: "image_description", 271: "make", 272: "model",
    273: "strip_offsets", 274: "orientation", 277: "samples_per_pixel", 278: "rows_per_strip", 279: "strip_byte_counts", 280: "min_sample_value",
    281: "max_sample_value", 282: "x_resolution", 283: "y_resolution", 284: "planar_configuration", 296: "resolution_unit", 305: "software",
    306: "date_time", 315: "artist", 316: "host_computer", 317: "predictor", 320: "colormap", 322: "tile_width", 323: "tile_height",
    324: "tile_offsets", 325: "tile_byte_counts", 338: "extra_samples", 339: "sample_format", 340: "s_min_sample_value", 341: "s_max_sample_value",
    347: "jpeg_tables", 33432: "copyright", 33550: "model_pixel_scale", 33922: "model_tiepoint", 34264: "model_transformation",
    34735: "geo_key_directory", 34736: "geo_double_params", 34737: "geo_ascii_params", 42112: "gdal_metadata", 42113: "gdal_nodata", 50674: "lerc_parameters",
}


def _enum(name: str, codes: dict[int, str]) -> type[IntEnum]:
    return IntEnum(name, {text.upper(): code for code, text in codes.items()}, module=__name__)


Compression = _enum("Compression", COMPRESSION)
PhotometricInterpretation = _enum("PhotometricInterpretation", PHOTOMETRIC)
PlanarConfiguration = _enum("PlanarConfiguration", PLANAR)
Predictor = _enum("Predictor", PREDICTOR)
ResolutionUnit = _enum("ResolutionUnit", RESOLUTION_UNIT)
SampleFormat = _enum("SampleFormat", SAMPLE_FORMAT)
Tag = _enum("Tag", TAGS)


def named(code: Column | str, names: dict[int, str]) -> Column:
    """The name of a code; an unknown code is its number as text."""
    code = F.col(code) if isinstance(code, str) else code
    chosen = F.when(F.lit(False), F.lit(""))
    for k, name in names.items():
        chosen = chosen.when(code == k, name)
    return chosen.otherwise(code.cast("string"))
