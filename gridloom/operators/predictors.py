"""Predictors and byte order with numpy, and their SQL twin for pixels in rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError


def unpredicted(data: bytes, predictor: int, order: str, dtype: str, height: int, width: int, samples: int) -> np.ndarray:
    """A tile's samples (height, width, samples) in native order. Differences run along whole tile rows and wrap at the sample's width."""
    kind = np.dtype(dtype)
    if len(data) != height * width * samples * kind.itemsize:
        raise FormatError(f"a tile of {len(data)} bytes, not {height * width * samples * kind.itemsize}")
    if predictor == 3:
        if kind.kind != "f":
            raise FormatError("floating-point predictor on integers")
        rows = np.frombuffer(data, np.uint8).reshape(height, width * kind.itemsize, samples)
        planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(height, kind.itemsize, width * samples)
        # Planes go from the high byte to the low one, whatever the file's byte order.
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).astype(kind).reshape(height, width, samples)
    numbers = np.frombuffer(data, kind.newbyteorder(order)).astype(kind).reshape(height, width, samples)
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        return np.cumsum(numbers.view(whole), axis=1, dtype=whole).view(kind)
    return numbers


def predicted(numbers: np.ndarray, predictor: int, order: str) -> bytes:
    """The inverse, for written rasters."""
    kind = numbers.dtype
    height, width, samples = numbers.shape
    if predictor == 3:
        planes = np.ascontiguousarray(numbers).astype(kind.newbyteorder(">")).view(np.uint8).reshape(height, width * samples, kind.itemsize).transpose(0, 2, 1)
        rows = np.ascontiguousarray(planes).reshape(height, width * kind.itemsize, samples)
        return np.diff(rows, axis=1, prepend=np.zeros((height, 1, samples), np.uint8)).astype(np.uint8).tobytes()
    if predictor == 2:
        whole = np.ascontiguousarray(numbers).view(f"u{kind.itemsize}")
        numbers = np.diff(whole, axis=1, prepend=np.zeros((height, 1, samples), whole.dtype)).astype(whole.dtype)
    return numbers.astype(numbers.dtype.newbyteorder(order)).tobytes()


def running_wrapped(rows: DataFrame, value: str, bits: int, by: list[str], along: list[Column | str]) -> DataFrame:
    """Horizontal un-prediction of values in rows: running sums of a row and band, modulo 2 ** bits."""
    w = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.pmod(F.sum(F.col(value)).over(w), F.lit(1 << bits)))
