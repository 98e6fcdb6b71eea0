"""Affine pixel and world coordinates; a geotransform is (x0, px, row_rotation, y0, col_rotation, py)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesta.functions.numeric import Name, col

Transform = Sequence[float] | Column


def _of(gt: Transform) -> list[Column]:
    return [gt[i] if isinstance(gt, Column) else F.lit(float(gt[i])) for i in range(6)]


def pixels_to_world(row: Name, column: Name, gt: Transform) -> tuple[Column, Column]:
    """World coordinates of a pixel's centre."""
    g = _of(gt)
    c, r = col(column) + 0.5, col(row) + 0.5
    return g[0] + c * g[1] + r * g[2], g[3] + c * g[4] + r * g[5]


def _inverse(x: Column, y: Column, gt: Transform) -> tuple[Column, Column]:
    g = _of(gt)
    det = g[1] * g[5] - g[2] * g[4]
    d = F.when(det == 0, F.raise_error("the geotransform cannot be inverted").cast("double")).otherwise(det)
    u, v = x - g[0], y - g[3]
    return (u * g[5] - v * g[2]) / d, (v * g[1] - u * g[4]) / d


def world_to_pixels(x: Name, y: Name, gt: Transform) -> tuple[Column, Column]:
    """Fractional (row, column); whole numbers are pixel centres."""
    c, r = _inverse(col(x), col(y), gt)
    return r - 0.5, c - 0.5


def world_cell(x: Name, y: Name, gt: Transform) -> tuple[Column, Column]:
    """(row, column) of the pixel that holds the point."""
    c, r = _inverse(col(x), col(y), gt)
    return F.floor(r).cast("int"), F.floor(c).cast("int")


def in_bounds(row: Name, column: Name, height: int, width: int) -> Column:
    r, c = col(row), col(column)
    return (r >= 0) & (r < height) & (c >= 0) & (c < width)


def bounds(height: int, width: int, gt: Sequence[float]) -> tuple[float, float, float, float]:
    """(min x, min y, max x, max y) of a grid, rotation included."""
    xs = [gt[0] + c * gt[1] + r * gt[2] for c in (0, width) for r in (0, height)]
    ys = [gt[3] + c * gt[4] + r * gt[5] for c in (0, width) for r in (0, height)]
    return min(xs), min(ys), max(xs), max(ys)
