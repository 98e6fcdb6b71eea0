"""Terrain and spectral bands over the derived elevation grid (10 m pixels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions import spectral
from cuesta.functions.numeric import finite
from cuesta.operators import normalise, stencils
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables

PX = 10.0
#: The nine neighbours by clamped joins, not by windows.
N9 = "n9 AS (SELECT p.grid_id, p.r, p.c, " + ", ".join(f"q{k}.z AS z{k}" for k in range(1, 10)) + " FROM fx_dem p " + " ".join(
    f"JOIN fx_dem q{3 * (i + 1) + j + 2} ON q{3 * (i + 1) + j + 2}.r = least(greatest(p.r + ({i}), 0), 47) AND q{3 * (i + 1) + j + 2}.c = least(greatest(p.c + ({j}), 0), 47)" for i in (-1, 0, 1) for j in (-1, 0, 1)
) + ")"
GRAD = "g AS (SELECT *, ((z3+2*z6+z9)-(z1+2*z4+z7))/80 AS fx, ((z1+2*z2+z3)-(z7+2*z8+z9))/80 AS fy FROM n9 WHERE isfinite(z5))"


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_dem"]


def slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stencils.nine(_dem(spark, sf_dir))
    fx, fy = stencils.gradients(PX)
    out = p.where(finite("z5")).select("r", "c", fx.alias("fx"), fy.alias("fy"), stencils.slope(PX).alias("slope"), stencils.aspect(PX).alias("aspect"))
    return comparable(out)


SLOPE_ASPECT = f"""WITH {N9}, {GRAD} SELECT r, c, {r('fx', 'fx')}, {r('fy', 'fy')},
 {r('degrees(atan(sqrt(fx*fx+fy*fy)))', 'slope')}, {r("CASE WHEN fx=0 AND fy=0 THEN 'NaN'::DOUBLE ELSE ((degrees(atan2(-fx,-fy)) % 360) + 360) % 360 END", 'aspect')} FROM g"""


def hillshades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stencils.nine(_dem(spark, sf_dir)).where(finite("z5"))
    return comparable(p.select("r", "c", stencils.hillshade(PX).alias("hillshade"), stencils.multi_hillshade(PX).alias("multi")))


def _shade(a: int) -> str:
    lit = f"((-fx*sin(radians({a}))*cos(radians(45)) - fy*cos(radians({a}))*cos(radians(45)) + sin(radians(45)))/sqrt(1+fx*fx+fy*fy))"
    return f"(CASE WHEN isnan({lit}) THEN {lit} ELSE least(greatest({lit}, 0), 1) END)"


HILLSHADES = f"WITH {N9}, {GRAD} SELECT r, c, {r(_shade(315), 'hillshade')}, {r('(' + '+'.join(map(_shade, (315, 45, 135, 225))) + ')/4', 'multi')} FROM g"


def curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stencils.nine(_dem(spark, sf_dir)).where(finite("z5"))
    kinds = [stencils.curvature(PX, kind=k).alias(k) for k in ("total", "plan", "profile")]
    return comparable(p.select("r", "c", *kinds, stencils.curvature_magnitude(PX).alias("magnitude")))


_PROFILE = "(CASE WHEN g*g+h*h=0 THEN 0 ELSE 2*(d*g*g+e*h*h+f*g*h)/(g*g+h*h) END)"
CURVATURES = f"""WITH {N9}, k AS (SELECT r, c, ((z4+z6)/2-z5)/100 AS d, ((z2+z8)/2-z5)/100 AS e, (-z1+z3+z7-z9)/400 AS f, (z6-z4)/20 AS g, (z2-z8)/20 AS h FROM n9 WHERE isfinite(z5))
 SELECT r, c, {r('-2*(d+e)', 'total')}, {r('CASE WHEN g*g+h*h=0 THEN 0 ELSE -2*(d*h*h+e*g*g-f*g*h)/(g*g+h*h) END', 'plan')}, {r(_PROFILE, 'profile')}, {r(f'abs({_PROFILE})+abs(-2*(d+e))', 'magnitude')} FROM k"""


def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(stencils.tpi(_dem(spark, sf_dir)).select("r", "c", "tpi"))


POSITION_INDEX = f"""SELECT p.r, p.c, {r('CASE WHEN isfinite(any_value(p.z)) THEN any_value(p.z) - avg(q.z) FILTER (isfinite(q.z)) END', 'tpi')}
 FROM fx_dem p CROSS JOIN range(-5, 6) a(i) CROSS JOIN range(-5, 6) b(j) JOIN fx_dem q ON q.r = least(greatest(p.r + i, 0), 47) AND q.c = least(greatest(p.c + j, 0), 47) GROUP BY p.r, p.c"""


def terrain_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered terrain bands, each stretched and joined: rows only, since its parts have oracles."""
    return comparable(stencils.terrain_stack(_dem(spark, sf_dir), PX, list(stencils.TERRAIN_BANDS)))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dem(spark, sf_dir).where(finite("z"))
    at = {"nir": "(r*7+c*3)%50", "red": "(r*5+c)%40", "blue": "(r+c)%30", "swir16": "(r*3+c*11)%60", "swir22": "(r*13+c)%45"}
    return p.select("grid_id", "r", "c", *(F.expr(f"cast({e} as double)").alias(n) for n, e in at.items()))


BANDS = "b AS (SELECT grid_id, r, c, ((r*7+c*3)%50)::DOUBLE AS nir, ((r*5+c)%40)::DOUBLE AS red, ((r+c)%30)::DOUBLE AS blue, ((r*3+c*11)%60)::DOUBLE AS swir16, ((r*13+c)%45)::DOUBLE AS swir22 FROM fx_dem WHERE isfinite(z))"


def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bands(spark, sf_dir)
    out = [spectral.ndvi("nir", "red").alias("ndvi"), spectral.ndmi("nir", "swir16").alias("ndmi"), spectral.clay_index("swir16", "swir22").alias("clay"), spectral.iron_oxide_index("red", "blue").alias("iron_oxide"), spectral.ferrous_index("swir16", "nir").alias("ferrous")]
    return comparable(b.select("r", "c", *out))


SPECTRAL_INDICES = f"WITH {BANDS} SELECT r, c, " + ", ".join(r(f"CASE WHEN {b}=0 THEN NULL ELSE {a}/({b}) END", n) for n, a, b in (("ndvi", "(nir-red)", "nir+red"), ("ndmi", "(nir-swir16)", "nir+swir16"), ("clay", "swir16", "swir22"), ("iron_oxide", "red", "blue"), ("ferrous", "swir16", "nir"))) + " FROM b"


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = normalise.percentile_stretch(_dem(spark, sf_dir), "z", name="stretched")
    p = normalise.stretch_u8(p, "z", name="byte")
    return comparable(normalise.cost_norm(p, "z", finite("z"), "cost").select("r", "c", "stretched", F.col("byte").cast("int").alias("byte"), "cost"))


STRETCHES = f"""WITH q AS (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM fx_dem WHERE isfinite(z)),
 s AS (SELECT r, c, isfinite(z) AS ok, least(greatest(((CASE WHEN isfinite(z) THEN z ELSE 0 END)-lo)/(hi-lo), 0), 1) AS v FROM fx_dem, q)
 SELECT r, c, {r('CASE WHEN ok THEN v END', 'stretched')}, CASE WHEN ok THEN CAST(floor(v*255 + 1e-9) AS INTEGER) ELSE 0 END AS byte, {r('v', 'cost')} FROM s"""


def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stretched bands joined by pixel and their weighted mean."""
    dem, b = _dem(spark, sf_dir), _bands(spark, sf_dir)
    full = dem.select("grid_id", "r", "c").join(b.select("grid_id", "r", "c", "nir"), ["grid_id", "r", "c"], "left")
    layers = {"elevation": dem, "nir": full.select("grid_id", "r", "c", F.coalesce("nir", F.lit(float("nan"))).alias("z"))}
    stack = normalise.assemble(layers)
    mean = normalise.weighted_response(stack, ["elevation", "nir"], [2.0, 1.0]).select("r", "c", "response")
    return comparable(stack.select("r", "c", "elevation", "nir").join(mean, ["r", "c"]))


def _stretch(c: str, lo: str, hi: str) -> str:
    return f"least(greatest(({c}-{lo})/({hi}-{lo}), 0), 1)"


BAND_STACK = f"""WITH {BANDS}, v AS (SELECT d.r, d.c, d.z, b.nir FROM fx_dem d LEFT JOIN b USING (r, c)),
 q AS (SELECT quantile_cont(z, 0.02) FILTER (isfinite(z)) AS l1, quantile_cont(z, 0.98) FILTER (isfinite(z)) AS h1, quantile_cont(nir, 0.02) AS l2, quantile_cont(nir, 0.98) AS h2 FROM v),
 s AS (SELECT r, c, CASE WHEN isfinite(z) AND nir IS NOT NULL THEN {_stretch('z', 'l1', 'h1')} END AS a, CASE WHEN isfinite(z) AND nir IS NOT NULL THEN {_stretch('nir', 'l2', 'h2')} END AS b FROM v, q),
 t AS (SELECT quantile_cont(a, 0.02) AS l1, quantile_cont(a, 0.98) AS h1, quantile_cont(b, 0.02) AS l2, quantile_cont(b, 0.98) AS h2 FROM s)
 SELECT r, c, {r('a', 'elevation')}, {r('b', 'nir')}, {r('CASE WHEN a IS NOT NULL THEN (2*' + _stretch('a', 'l1', 'h1') + '+' + _stretch('b', 'l2', 'h2') + ')/3 END', 'response')} FROM s, t"""


def edge_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(stencils.edge_response(_dem(spark, sf_dir), "z").select("r", "c", "response"))


EDGE_RESPONSE = f"""WITH q AS (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM fx_dem WHERE isfinite(z)), {N9},
 g AS (SELECT r, c, {", ".join(f"CASE WHEN isfinite(z{k}) THEN {_stretch(f'z{k}', 'lo', 'hi')} ELSE z{k} END AS y{k}" for k in range(1, 10))} FROM n9, q)
 SELECT r, c, {r('CASE WHEN isfinite(y5) THEN sqrt(pow(((y3+2*y6+y9)-(y1+2*y4+y7))/8, 2) + pow(((y1+2*y2+y3)-(y7+2*y8+y9))/8, 2)) END', 'response')} FROM g"""

QUERIES = {
    "t1_slope_aspect": (slope_aspect, SLOPE_ASPECT),
    "t4_hillshades": (hillshades, HILLSHADES),
    "t6_position_index": (position_index, POSITION_INDEX),
    "t7_curvatures": (curvatures, CURVATURES),
    "t8_terrain_stack": (terrain_stack, None),
    "b1_spectral_indices": (spectral_indices, SPECTRAL_INDICES),
    "b8_stretches": (stretches, STRETCHES),
    "b13_band_stack": (band_stack, BAND_STACK),
    "e10_edge_response": (edge_response, EDGE_RESPONSE),
}
