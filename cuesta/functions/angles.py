"""Azimuths, strikes and lines in degrees; vectors are (x east, y north, z up)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesta.functions.numeric import nan, Name, col, finite, modulo


def azimuth(x: Column, y: Column) -> Column:
    """Degrees clockwise from north of the direction (x, y)."""
    return modulo(F.degrees(F.atan2(x, y)), 360)


def strike_difference(a: Name, b: Name) -> Column:
    """Acute gap of two undirected strikes."""
    d = modulo(F.abs(col(a) - col(b)), 180)
    return F.least(d, 180 - d)


def doubled(strike: Name) -> tuple[Column, Column]:
    """(sin, cos) of twice the strike."""
    two = F.radians(2 * col(strike))
    return F.sin(two), F.cos(two)


def mean_strike(sin2: Column, cos2: Column) -> Column:
    """Doubled-angle mean from the means of sin and cos; NaN where they cancel or are missing."""
    r = F.hypot(sin2, cos2)
    return F.when(r >= 1e-12, modulo(F.degrees(F.atan2(sin2, cos2)) / 2, 180)).otherwise(nan())


def resultant(sin2: Column, cos2: Column) -> Column:
    return F.coalesce(F.hypot(sin2, cos2), nan())


def circular_deviation(r: Column) -> Column:
    """sqrt(-2 ln R), in radians."""
    return F.sqrt(-2 * F.ln(F.when(r > 0, F.least(r, F.lit(1.0)))))


def line_vector(trend: Name, plunge: Name) -> tuple[Column, Column, Column]:
    t, p = F.radians(col(trend)), F.radians(col(plunge))
    return F.cos(p) * F.sin(t), F.cos(p) * F.cos(t), -F.sin(p)


def vector_line(x: Name, y: Name, z: Name, lower: bool = True) -> tuple[Column, Column]:
    """(trend, plunge) of a vector, turned down if lower; vertical ones have trend 0, zero and non-finite ones NaN."""
    x, y, z = col(x), col(y), col(z)
    n = F.sqrt(x * x + y * y + z * z)
    ok = finite(n) & (n > 0)
    size = F.when(ok, n)
    sign = F.when(z > 0, F.lit(-1.0)).otherwise(F.lit(1.0)) if lower else F.lit(1.0)
    u, v, w = sign * x / size, sign * y / size, sign * z / size
    trend = F.when(F.hypot(u, v) < 1e-12, F.lit(0.0)).otherwise(azimuth(u, v))
    plunge = F.degrees(F.asin(F.least(F.greatest(-w, F.lit(-1.0)), F.lit(1.0))))
    return F.when(ok, trend).otherwise(nan()), F.when(ok, plunge).otherwise(nan())


def pole(strike: Name, dip: Name) -> tuple[Column, Column]:
    """(trend, plunge) of a plane's downward normal."""
    return modulo(col(strike) - 90, 360), 90 - col(dip)


def plane_of_pole(x: Name, y: Name, z: Name) -> tuple[Column, Column]:
    """(strike, dip) of the plane with this pole."""
    trend, plunge = vector_line(x, y, z)
    return modulo(trend + 90, 360), 90 - plunge


def equal_area(trend: Name, plunge: Name) -> tuple[Column, Column]:
    """Lower-hemisphere equal-area projection in the unit circle."""
    t = F.radians(col(trend))
    r = F.sqrt(F.least(F.greatest(1 - F.sin(F.radians(col(plunge))), F.lit(0.0)), F.lit(2.0)))
    return r * F.sin(t), r * F.cos(t)


def equal_area_vector(x: Name, y: Name, z: Name) -> tuple[Column, Column]:
    """The same for a vector, without going through its trend; vertical ones fall on the centre."""
    x, y, z = col(x), col(y), col(z)
    s = F.when(z > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    h = F.hypot(x, y)
    r = F.sqrt(F.greatest(1 + s * z, F.lit(0.0)))
    return (F.when(h > 0, s * r * v / F.when(h > 0, h)).otherwise(F.lit(0.0)) for v in (x, y))


def morphology(dip: Name, vertical: float = 75, horizontal: float = 20) -> Column:
    """Outcrop form by dip: straight, contour-parallel or V; NULL without a dip."""
    d = col(dip)
    return F.when(~finite(d), F.lit(None)).when(d >= vertical, "straight").when(d <= horizontal, "contour-parallel").otherwise("V")
