"""Spectral indices; null where a denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def reflectance(band: Column) -> Column:
    return band / SCALE


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi(b8: Column, b4: Column) -> Column:
    return normalized_difference(b8, b4)


def evi(b8: Column, b4: Column, b2: Column) -> Column:
    return 2.5 * F.try_divide(b8 - b4, b8 + 6 * b4 - 7.5 * b2 + 1)


def cire(b7: Column, b5: Column) -> Column:
    return F.try_divide(b7, b5) - 1


def ndwi(b3: Column, b8: Column) -> Column:
    return normalized_difference(b3, b8)
