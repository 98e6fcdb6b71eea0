"""Stencils over long-form grids: one row per pixel (grid_id, r, c, value), nodata NaN.

Neighbours come from two separable window passes (along rows, then along
columns), so no self-join is made and the grid is shuffled by row and by column
only, whatever the number of derived bands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuesta.functions.angles import azimuth
from cuesta.functions.numeric import nan, Name, clip, col, finite, or_nan


def along_row() -> WindowSpec:
    return Window.partitionBy("grid_id", "r").orderBy("c")


def along_column() -> WindowSpec:
    return Window.partitionBy("grid_id", "c").orderBy("r")


def nine(pixels: DataFrame, z: str = "z", outside: Column | None = None) -> DataFrame:
    """pixels with z1..z9 (NW..SE, z5 the centre); past the edge the edge repeats, or ``outside`` stands."""
    edge = F.col(z) if outside is None else outside
    rows = pixels.withColumn("_w", F.coalesce(F.lag(z).over(along_row()), edge)).withColumn("_e", F.coalesce(F.lead(z).over(along_row()), edge))
    line = F.struct(F.col("_w").alias("w"), F.col(z).alias("m"), F.col("_e").alias("e"))
    none = line if outside is None else F.struct(outside.alias("w"), outside.alias("m"), outside.alias("e"))
    rows = rows.withColumn("_n", F.coalesce(F.lag(line).over(along_column()), none)).withColumn("_s", F.coalesce(F.lead(line).over(along_column()), none))
    z9 = ["_n.w", "_n.m", "_n.e", "_w", z, "_e", "_s.w", "_s.m", "_s.e"]
    return rows.select(*pixels.columns, *(F.col(c).alias(f"z{i + 1}") for i, c in enumerate(z9)))


def _check(px: float, py: float | None) -> tuple[float, float]:
    py = px if py is None else py
    if px <= 0 or py <= 0:
        raise ValueError("pixel sizes must be positive")
    return float(px), float(py)


def gradients(px: float, py: float | None = None) -> tuple[Column, Column]:
    """(d/d east, d/d north) of z1..z9 after Horn; NaN at nodata."""
    px, py = _check(px, py)
    z = [None, *(F.col(f"z{i}") for i in range(1, 10))]
    fx = ((z[3] + 2 * z[6] + z[9]) - (z[1] + 2 * z[4] + z[7])) / (8 * px)
    fy = ((z[1] + 2 * z[2] + z[3]) - (z[7] + 2 * z[8] + z[9])) / (8 * py)
    ok = finite(z[5])
    return F.when(ok, fx).otherwise(nan()), F.when(ok, fy).otherwise(nan())


def slope(px: float, py: float | None = None, degrees: bool = True) -> Column:
    fx, fy = gradients(px, py)
    a = F.atan(F.hypot(fx, fy))
    return F.degrees(a) if degrees else a


def aspect(px: float, py: float | None = None) -> Column:
    """Azimuth of the way down; NaN on flat ground."""
    fx, fy = gradients(px, py)
    return F.when((fx == 0) & (fy == 0), nan()).otherwise(azimuth(-fx, -fy))


def hillshade(px: float, py: float | None = None, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Cosine of the angle between the surface normal and the sun, in [0, 1]."""
    fx, fy = gradients(px, py)
    a, h = F.radians(F.lit(float(azimuth))), F.radians(F.lit(float(altitude)))
    lit = (-fx * F.sin(a) * F.cos(h) - fy * F.cos(a) * F.cos(h) + F.sin(h)) / F.sqrt(1 + fx * fx + fy * fy)
    return clip(lit, 0, 1)


def multi_hillshade(px: float, py: float | None = None, azimuths: Sequence[float] = (315, 45, 135, 225), altitude: float = 45.0) -> Column:
    if not azimuths:
        raise ValueError("at least one azimuth is needed")
    total = hillshade(px, py, azimuths[0], altitude)
    for a in azimuths[1:]:
        total = total + hillshade(px, py, a, altitude)
    return total / len(azimuths)


def curvature(px: float, py: float | None = None, kind: str = "total") -> Column:
    """Total, plan or profile curvature after Zevenbergen and Thorne; 0 where the slope is 0."""
    px, py = _check(px, py)
    size = (px + py) / 2
    z = [None, *(F.col(f"z{i}") for i in range(1, 10))]
    d = ((z[4] + z[6]) / 2 - z[5]) / (size * size)
    e = ((z[2] + z[8]) / 2 - z[5]) / (size * size)
    f = (-z[1] + z[3] + z[7] - z[9]) / (4 * size * size)
    g = (-z[4] + z[6]) / (2 * size)
    h = (z[2] - z[8]) / (2 * size)
    steep = g * g + h * h
    if kind == "total":
        out = -2 * (d + e)
    elif kind == "plan":
        out = F.when(steep == 0, F.lit(0.0)).otherwise(-2 * (d * h * h + e * g * g - f * g * h) / F.when(steep != 0, steep))
    elif kind == "profile":
        out = F.when(steep == 0, F.lit(0.0)).otherwise(2 * (d * g * g + e * h * h + f * g * h) / F.when(steep != 0, steep))
    else:
        raise ValueError(f"unknown kind of curvature: {kind}")
    return F.when(finite(z[5]), out).otherwise(nan())


def box_sum(pixels: DataFrame, value: Column, radius: int, name: str) -> DataFrame:
    """pixels with the sum of value over the (2 radius + 1) square; cells past the edge repeat the edge's."""
    out = pixels.withColumn("_v", value)
    for window, at in ((along_row(), "c"), (along_column(), "r")):
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = F.min(at).over(whole), F.max(at).over(whole)
        out = out.withColumn(
            "_v",
            F.sum("_v").over(window.rowsBetween(-radius, radius))
            + F.greatest(radius - (F.col(at) - low), F.lit(0)) * F.first("_v").over(whole)
            + F.greatest(radius - (high - F.col(at)), F.lit(0)) * F.last("_v").over(whole),
        )
    return out.withColumn(name, F.col("_v")).drop("_v")


def tpi(pixels: DataFrame, radius: int = 5, z: str = "z", name: str = "tpi") -> DataFrame:
    """pixels with z minus the mean of the finite cells around it; NaN at nodata or without any."""
    if radius < 1:
        raise ValueError("the radius must be at least 1")
    ok = finite(z)
    out = box_sum(pixels, F.when(ok, F.col(z)).otherwise(0.0), radius, "_sum")
    out = box_sum(out, F.when(ok, 1.0).otherwise(0.0), radius, "_count")
    mean = F.col("_sum") / F.when(F.col("_count") > 0, F.col("_count"))
    return out.withColumn(name, F.when(ok, or_nan(F.col(z) - mean)).otherwise(nan())).drop("_sum", "_count")


#: Terrain bands by name, as expressions of the pixel size over z1..z9.
TERRAIN_BANDS = {
    "elevation": lambda px, py: F.col("z5"),
    "slope": slope,
    "hillshade": hillshade,
    "multi_hillshade": multi_hillshade,
    "tpi": lambda px, py: F.col("tpi"),
    "curvature": lambda px, py: curvature(px, py, "total"),
    "plan_curvature": lambda px, py: curvature(px, py, "plan"),
    "profile_curvature": lambda px, py: curvature(px, py, "profile"),
}


def terrain_stack(pixels: DataFrame, px: float, names: Sequence[str], py: float | None = None, tpi_radius: int = 5) -> DataFrame:
    """(grid_id, r, c, one column per named band); neighbours are taken once for all bands."""
    unknown = [n for n in names if n not in TERRAIN_BANDS]
    if unknown:
        raise KeyError(f"unknown terrain bands: {', '.join(unknown)}")
    base = tpi(pixels, tpi_radius) if "tpi" in names else pixels
    return nine(base).select("grid_id", "r", "c", *(TERRAIN_BANDS[n](px, py).alias(n) for n in names))


def curvature_magnitude(px: float, py: float | None = None) -> Column:
    return F.abs(curvature(px, py, "profile")) + F.abs(curvature(px, py, "total"))


def edge_response(pixels: DataFrame, band: Name) -> DataFrame:
    """(grid_id, r, c, response): gradient magnitude of a stretched band at unit pixels."""
    from cuesta.operators.normalise import percentile_stretch

    stretched = percentile_stretch(pixels.select("grid_id", "r", "c", col(band).alias("z")), "z")
    fx, fy = gradients(1.0)
    return nine(stretched).select("grid_id", "r", "c", F.hypot(fx, fy).alias("response"))
