"""Closed-form eigenvalues and eigenvectors of symmetric 2x2 and 3x3 matrices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def eigenvalues2(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """(larger, smaller)."""
    mean, gap = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    return mean + gap, mean - gap


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Descending eigenvalues by the trigonometric solution of the characteristic cubic."""
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    s = F.when(p > 0, p).otherwise(F.lit(1.0))
    a, b, c, d, e, f = (xx - q) / s, (yy - q) / s, (zz - q) / s, xy / s, xz / s, yz / s
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    one = q + 2 * p * F.cos(phi)
    three = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return one, 3 * q - one - three, three


def eigenvector3(value: Column, xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """A unit eigenvector: the longest cross product of two rows of the shifted matrix."""
    r = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]

    def cross(u, v):
        return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]

    candidates = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        c = cross(r[i], r[j])
        candidates.append(F.struct((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("n"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z")))
    best = F.greatest(*candidates)
    n = F.sqrt(best["n"])
    size = F.when(n > 0, n)
    return best["x"] / size, best["y"] / size, best["z"] / size
