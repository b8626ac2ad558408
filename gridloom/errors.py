"""Errors of the raster engine. Permissive scans and decodes put their text in an `error` column instead."""


class RasterError(Exception):
    """Any error of the engine."""


class FormatError(RasterError):
    """The file breaks the TIFF format."""


class CycleError(FormatError):
    """An image directory points back to an earlier one."""


class UnsupportedCompression(RasterError):
    """No decoder is registered for the compression."""


class UnsupportedLayout(RasterError):
    """The pixel layout can't be decoded: mixed or odd sample types."""
