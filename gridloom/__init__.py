"""Raster analytics on PySpark: tiled TIFF files as Spark relations."""

from .errors import CycleError, FormatError, RasterError, UnsupportedCompression, UnsupportedLayout
from .functions.names import Compression, PhotometricInterpretation, PlanarConfiguration, Predictor, ResolutionUnit, SampleFormat, Tag
from .plans.raster import Raster
from .sources.raster_writer import Layout

__all__ = [
    "Compression", "CycleError", "FormatError", "Layout", "PhotometricInterpretation", "PlanarConfiguration", "Predictor", "Raster", "RasterError",
    "ResolutionUnit", "SampleFormat", "Tag", "UnsupportedCompression", "UnsupportedLayout",
]
__version__ = "0.1.0"
