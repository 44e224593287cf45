"""Boxes and distances of page elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes (x, y, width, height)."""
    side = lambda k: F.greatest(F.lit(0), F.least(a[k] + a[k + 2], b[k] + b[k + 2]) - F.greatest(a[k], b[k]))
    return side(0) * side(1)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    common = box_overlap(a, b)
    return common / (a[2] * a[3] + b[2] * b[3] - common)


def point_to_box(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Distance of a point to a box; 0 inside."""
    off = lambda v, lo, hi: F.greatest(F.lit(0), F.lit(lo) - v, v - F.lit(hi))
    return F.sqrt(F.pow(off(x, x0, x1), F.lit(2)) + F.pow(off(y, y0, y1), F.lit(2)))


def heading_weight(level: Column) -> Column:
    """1 for h1, .17 less for each further level, 0 for what is no heading."""
    return F.when(level <= 6, 1 - (level - 1) * 0.17).otherwise(F.lit(0.0))
