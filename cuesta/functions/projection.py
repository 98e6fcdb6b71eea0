"""Transverse Mercator on the WGS84 ellipsoid, forward and back, in the zones of UTM: Krüger's series in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesta.functions.numeric import Name, col, held

# The ellipsoid, the scale on the central meridian, and the false origin.
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
# Coefficients of the published series, rows by multiple of the angle, columns by power of the third flattening.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600],
    [0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840],
    [0, 0, 0, 0, 0, 212378941 / 319334400],
]
INVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600],
    [0, 0, 0, 0, 4583 / 161280, -108847 / 3991680],
    [0, 0, 0, 0, 0, 20648693 / 638668800],
]

_F = 1 / INVERSE_FLATTENING
_N = _F / (2 - _F)
ECCENTRICITY = (_F * (2 - _F)) ** 0.5
#: Radius of the circle whose circumference is that of a meridian.
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def series(table: list[list[float]]) -> list[float]:
    """The series' coefficient for each multiple of the angle."""
    return [sum(a * _N ** (k + 1) for k, a in enumerate(row)) for row in table]


def utm_zone(lon: Name) -> Column:
    """The zone of a longitude in degrees, 1 to 60; 180 belongs to the first."""
    return (F.pmod(F.floor((col(lon) + 180) / 6), F.lit(60)) + 1).cast("int")


def central_meridian(zone: Name) -> Column:
    return (col(zone) * 6 - 183).cast("double")


def _sums(x: Column, y: Column, table: list[list[float]]) -> tuple[Column, Column]:
    along, across = F.lit(0.0), F.lit(0.0)
    for k, a in enumerate(series(table)):
        m = 2.0 * (k + 1)
        along = along + a * F.sin(m * x) * F.cosh(m * y)
        across = across + a * F.cos(m * x) * F.sinh(m * y)
    return along, across


def _free(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"columns in use: {', '.join(taken)}")


def to_utm(points: DataFrame, lon: str = "lon", lat: str = "lat", zone: str | None = None) -> DataFrame:
    """points with zone (unless a column is named), north, easting and northing of degrees lon and lat.

    Good to less than a micrometre within a zone and to a millimetre far beyond.  NULL or NaN degrees give the same.
    """
    _free(points, *([] if zone else ["zone"]), "north", "easting", "northing")
    p = points if zone else points.withColumn("zone", utm_zone(lon))
    phi, turn = F.radians(col(lat)), F.radians(F.pmod(col(lon) - central_meridian(zone or "zone") + 180, F.lit(360.0)) - 180)
    s = F.sin(phi)
    p = held(p, {"_utm_t": F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s)), "_utm_c": F.cos(turn), "_utm_s": F.sin(turn)})
    p = held(p, {"_utm_x": F.atan2(F.col("_utm_t"), F.col("_utm_c")), "_utm_y": F.asinh(F.col("_utm_s") / F.hypot("_utm_t", "_utm_c"))})
    along, across = _sums(F.col("_utm_x"), F.col("_utm_y"), FORWARD)
    north = col(lat) >= 0
    p = p.withColumn("north", north).withColumn("easting", FALSE_EASTING + SCALE * RADIUS * (F.col("_utm_y") + across))
    p = p.withColumn("northing", F.when(north, 0.0).otherwise(FALSE_NORTHING) + SCALE * RADIUS * (F.col("_utm_x") + along))
    return p.drop("_utm_t", "_utm_c", "_utm_s", "_utm_x", "_utm_y")


def from_utm(points: DataFrame, easting: str = "easting", northing: str = "northing", zone: str = "zone", north: str = "north") -> DataFrame:
    """points with lon and lat in degrees of UTM coordinates; the latitude comes from the conformal one by three of Newton's steps."""
    _free(points, "lon", "lat")
    x = (col(northing) - F.when(col(north), 0.0).otherwise(FALSE_NORTHING)) / (SCALE * RADIUS)
    p = held(points, {"_utm_x": x, "_utm_y": (col(easting) - FALSE_EASTING) / (SCALE * RADIUS)})
    along, across = _sums(F.col("_utm_x"), F.col("_utm_y"), INVERSE)
    p = held(p, {"_utm_p": F.col("_utm_x") - along, "_utm_q": F.col("_utm_y") - across})
    p = held(p, {"_utm_u": F.sin("_utm_p") / F.hypot(F.sinh("_utm_q"), F.cos("_utm_p")), "_utm_w": F.atan2(F.sinh("_utm_q"), F.cos("_utm_p"))})
    e2 = ECCENTRICITY**2
    p = p.withColumn("_utm_v", F.col("_utm_u"))
    for _ in range(3):
        v, h = F.col("_utm_v"), F.sqrt(1 + F.col("_utm_v") * F.col("_utm_v"))
        p = held(p, {"_utm_h": h, "_utm_g": F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * v / h))})
        here = v * F.sqrt(1 + F.col("_utm_g") * F.col("_utm_g")) - F.col("_utm_g") * F.col("_utm_h")
        p = held(p, {"_utm_k": here})
        step = (F.col("_utm_u") - F.col("_utm_k")) / F.sqrt(1 + F.col("_utm_k") * F.col("_utm_k")) * (1 + (1 - e2) * v * v) / ((1 - e2) * F.col("_utm_h"))
        p = held(p, {"_utm_n": v + step}).drop("_utm_v", "_utm_h", "_utm_g", "_utm_k").withColumnRenamed("_utm_n", "_utm_v")
    lon = F.pmod(F.degrees(F.col("_utm_w")) + central_meridian(zone) + 180, F.lit(360.0)) - 180
    return p.withColumn("lon", lon).withColumn("lat", F.degrees(F.atan(F.col("_utm_v")))).drop("_utm_x", "_utm_y", "_utm_p", "_utm_q", "_utm_u", "_utm_w", "_utm_v")
