"""Projection, poles, pixels of lines, tangents, and grids that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions import angles, projection
from cuesta.functions.numeric import finite
from cuesta.operators import attitude, directional, polyline
from cuesta.operators.fixpoint import shared_folder
from cuesta.plans import oracles
from cuesta.plans.attitudes import GT, SAMPLED
from cuesta.plans.compare import comparable, r, rounded
from cuesta.plans.directions import _UNITS, _vectors
from cuesta.plans.fixtures import tables
from cuesta.sources import rasters


def utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a point of the earth, in UTM and back again."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = orders.selectExpr("o_orderkey AS id", "cast((o_orderkey * 37) % 3600 as double) / 10 - 180 AS a", "cast((o_custkey * 13 + o_orderkey) % 1600 as double) / 10 - 80 AS b")
    out = projection.from_utm(projection.to_utm(p, "a", "b"))
    return out.select("id", "zone", "north", *(rounded(c, k).alias(c) for c, k in (("easting", 2), ("northing", 2), ("lon", 5), ("lat", 5))))


def _sums(x: str, y: str, along: bool) -> str:
    f, g = ("sin", "cosh") if along else ("cos", "sinh")
    return "+".join(f"({a!r}*{f}({2 * (k + 1)}*{x})*{g}({2 * (k + 1)}*{y}))" for k, a in enumerate(projection.series(projection.FORWARD)))


_E = projection.ECCENTRICITY
UTM = f"""WITH p AS (SELECT o_orderkey AS id, CAST((o_orderkey*37)%3600 AS DOUBLE)/10-180 AS lon, CAST((o_custkey*13+o_orderkey)%1600 AS DOUBLE)/10-80 AS lat FROM orders),
 z AS (SELECT *, CAST(floor((lon+180)/6) AS INTEGER) % 60 + 1 AS zone, sin(radians(lat)) AS s FROM p), t AS (SELECT *, sinh(atanh(s)-{_E!r}*atanh({_E!r}*s)) AS t, radians(lon-(zone*6-183)) AS l FROM z),
 x AS (SELECT *, atan2(t, cos(l)) AS x, asinh(sin(l)/sqrt(t*t+cos(l)*cos(l))) AS y FROM t)
 SELECT id, zone, lat >= 0 AS north, {r(f"500000+{projection.SCALE * projection.RADIUS!r}*(y+{_sums('x', 'y', False)})", 'easting', 2)},
 {r(f"CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END+{projection.SCALE * projection.RADIUS!r}*(x+{_sums('x', 'y', True)})", 'northing', 2)}, {r('lon', 'lon', 5)}, {r('lat', 'lat', 5)} FROM x"""


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_att"]


def poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of every attitude, their projections, and the planes that they give back."""
    p = directional.poles(_planes(spark, sf_dir).where("dip > 0"))
    u, v = angles.equal_area_vector("x", "y", "z")
    strike, dip = angles.plane_of_pole("x", "y", "z")
    return comparable(p.select("id", "x", "y", "z", u.alias("u"), v.alias("v"), strike.alias("back_strike"), dip.alias("back_dip")))


POLES = f"""WITH p AS (SELECT id, strike, dip, radians((strike+270) % 360) AS t, radians(90-dip) AS q FROM fx_att WHERE dip > 0)
 SELECT id, {r('cos(q)*sin(t)', 'x')}, {r('cos(q)*cos(t)', 'y')}, {r('-sin(q)', 'z')}, {r('sqrt(greatest(1-sin(q), 0))*sin(t)', 'u')}, {r('sqrt(greatest(1-sin(q), 0))*cos(t)', 'v')}, {r('strike', 'back_strike')}, {r('dip', 'back_dip')} FROM p"""


def straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a straight line for every order."""
    p = _planes(spark, sf_dir).selectExpr("id", "cast((id * 7) % 48 as int) AS r1", "cast((id * 11) % 48 as int) AS c1", "cast((id * 5) % 31 as int) AS r2", "cast((id * 3) % 43 as int) AS c2")
    return polyline.straight_pixels(p)


STRAIGHT = """WITH p AS (SELECT id, CAST((id*7)%48 AS INTEGER) AS r1, CAST((id*11)%48 AS INTEGER) AS c1, CAST((id*5)%31 AS INTEGER) AS r2, CAST((id*3)%43 AS INTEGER) AS c2 FROM fx_att),
 n AS (SELECT *, greatest(abs(r2-r1), abs(c2-c1)) AS n FROM p), k AS (SELECT *, CAST(unnest(range(0, n + 1)) AS INTEGER) AS k FROM n)
 SELECT id, k, CAST(round_even(r1+(r2-r1)*CASE WHEN n > 0 THEN k/n ELSE 0 END, 0) AS INTEGER) AS r, CAST(round_even(c1+(c2-c1)*CASE WHEN n > 0 THEN k/n ELSE 0 END, 0) AS INTEGER) AS c FROM k"""


def tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of both ends of every trace over four vertices, and their orientation."""
    t = polyline.end_tangents(tables(spark, sf_dir)["fx_vert"])
    return comparable(t.select("trace_id", "end", "x", "y", "dx", "dy", polyline.orientation(F.col("dx"), F.col("dy")).alias("orientation")))


def _end(end: int, order: str) -> str:
    return f"SELECT trace_id, {end} AS \"end\", first(x ORDER BY k) AS x, first(y ORDER BY k) AS y, first(x ORDER BY k)-last(x ORDER BY k) AS dx, first(y ORDER BY k)-last(y ORDER BY k) AS dy FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq {order}) AS k FROM fx_vert) WHERE k <= 4 GROUP BY trace_id HAVING count(*) > 1"


TANGENTS = f"WITH e AS ({_end(0, 'ASC')} UNION ALL {_end(1, 'DESC')}) SELECT trace_id, \"end\", {r('x', 'x')}, {r('y', 'y')}, {r('dx', 'dx')}, {r('dy', 'dy')}, {r('CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE ((degrees(atan2(dx, dy)) % 180) + 180) % 180 END', 'orientation')} FROM e"


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular spread of the strikes of each region, and how many pass the gate and the rule on relief."""
    s, c = angles.doubled("strike")
    p = _planes(spark, sf_dir).withColumn("conditioning", F.col("dip") / 4000).withColumn("map_conditioning", F.col("x") / 4_000_000).withColumn("relief", F.col("y") % 160)
    r_ = angles.resultant(F.avg(s), F.avg(c))
    out = p.groupBy("region").agg(angles.circular_deviation(r_).alias("deviation"), F.count_if(attitude.reliable()).alias("reliable"), F.count_if(attitude.relief_ok()).alias("steep"))
    return comparable(out)


SPREAD = f"SELECT region, {r('sqrt(-2*ln(sqrt(pow(avg(sin(radians(2*strike))), 2)+pow(avg(cos(radians(2*strike))), 2))))', 'deviation')}, count(*) FILTER (dip/4000 >= 1e-2 AND x/4000000 >= 1e-3) AS reliable, count(*) FILTER (y % 160 >= 80) AS steep FROM fx_att GROUP BY region"


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights written as a grid with a nodata value in the shared folder, and read again."""
    path = f"{shared_folder(spark)}/cuesta/{uuid.uuid4().hex}"
    rasters.write_grid(tables(spark, sf_dir)["fx_dem"], path, ["z"])
    back = rasters.read_grid(spark, path, ["z"])
    return comparable(back.select("grid_id", "r", "c", "z", finite("z").alias("known")), 3)


WRITTEN = f"SELECT grid_id, r, c, {r('z', 'z', 3)}, isfinite(z) AS known FROM fx_dem"

def axial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.axial_mean(_vectors(spark, sf_dir), "label"), 4)


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of every trace with eight samples or more."""
    t = tables(spark, sf_dir)
    fits = attitude.fit_planes(polyline.sample_trace(t["fx_vert"], t["fx_dem"], GT, 30.0), 8)
    wide = fits.select("trace_id", F.col("n_samples").cast("long").alias("n_samples"), *(rounded(c, k).alias(c) for c, k in (("strike", 3), ("dip", 4), ("dip_direction", 3), ("conditioning", 5), ("planarity", 5), ("residual_rms", 4))))
    return wide


QUERIES = {
    "m1_planes": (planes, oracles.planes(SAMPLED)),
    "x13_axial_means": (axial_means, oracles.axial(_UNITS)),
    "p7_utm": (utm, UTM),
    "x11_poles": (poles, POLES),
    "l12_straight": (straight, STRAIGHT),
    "a10_tangents": (tangents, TANGENTS),
    "v4_spread": (spread, SPREAD),
    "k3_written": (written, WRITTEN),
}
