"""Perceptual hashes of grey pictures as native array products."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import bound

#: Low frequencies along each axis.
SIDE = 8


def cosines(n: int) -> Column:
    """cos(pi u (2 x + 1) / 2 n) for u below SIDE and x below n, as an array of arrays."""
    return F.array(*(F.array(*(F.lit(math.cos(math.pi * u * (2 * x + 1) / (2 * n))) for x in range(n))) for u in range(SIDE)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def coefficients(pixels: Column, height: int, width: int) -> Column:
    """SIDE * SIDE low-frequency coefficients of the cosine transform of an array of grey values, row by row, of which the mean is taken; so pictures of different sizes compare."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(pixels, r * width + 1, width))
    along = F.transform(cosines(width), lambda c: F.transform(rows, lambda r: _dot(r, c)))  # by frequency, then by row
    both = F.transform(cosines(height), lambda d: F.transform(along, lambda a: F.round(_dot(a, d) / (height * width), 6)))
    return F.flatten(both)


def perceptual_hash(pixels: Column, height: int, width: int) -> Column:
    """64 bits: which coefficients are over their median (the mean of the two middle ones); the first one, the mean of the pixels, is the lowest bit."""

    def bits(c: Column, s: Column) -> Column:
        median = (s[SIDE * SIDE // 2 - 1] + s[SIDE * SIDE // 2]) / 2
        return bound(median, lambda m: F.aggregate(F.transform(c, lambda x, i: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(x)))

    return bound(coefficients(pixels.cast("array<double>"), height, width), lambda c: bound(F.array_sort(c), lambda s: bits(c, s)))


def grey_pixels(images: DataFrame, column: str = "image") -> DataFrame:
    """images with height, width and pixels (array<double>): grey values of pictures as Spark's image source reads them (8 bits, blue green red, or grey), by the usual weights of the colours."""
    i = F.col(column)
    at = lambda k: F.conv(F.hex(F.substring(i["data"], k + 1, F.lit(1))), 16, 10).cast("double")
    n = i["nChannels"]
    grey = lambda p: F.when(n == 1, at(p)).otherwise(0.114 * at(p * n) + 0.587 * at(p * n + 1) + 0.299 * at(p * n + 2))
    return images.select("*", i["height"].alias("height"), i["width"].alias("width"), F.transform(F.sequence(F.lit(0), i["height"] * i["width"] - 1), grey).alias("pixels"))
