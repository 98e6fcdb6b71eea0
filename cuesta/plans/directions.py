"""Directional statistics of the first three elements of the embeddings and of the derived attitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions import angles
from cuesta.operators import directional
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables

OUTLINE = [(-0.5, -0.5), (0.6, -0.3), (0.2, 0.1), (0.4, 0.7), (-0.4, 0.5)]
_UNITS = "u AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), v AS (SELECT label, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM u WHERE sqrt(x*x+y*y+z*z) > 1e-12)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("label", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_att"]


def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.fisher_mean(_vectors(spark, sf_dir), "label"), 4)


FISHER = f"""WITH {_UNITS}, m AS (SELECT label, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM v GROUP BY label), k AS (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM m)
 SELECT label, n, {r('l', 'resultant', 4)}, {r('((degrees(atan2(x, y)) % 360) + 360) % 360', 'trend', 4)}, {r('degrees(asin(-z/l))', 'plunge', 4)}, {r('CASE WHEN n > 1 THEN (n-1)/(n-l) END', 'kappa', 4)},
 {r('CASE WHEN n > 1 THEN degrees(acos(greatest(-1, least(1, 1-(n-l)/l*(pow(20, 1.0/(n-1))-1))))) END', 'alpha', 4)}, {r('CASE WHEN n > 1 THEN 81/sqrt((n-1)/(n-l)) END', 'csd', 4)} FROM k"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.orientation_tensor(_vectors(spark, sf_dir), "label"))


TENSORS = f"WITH {_UNITS} SELECT label, count(*) AS n, " + ", ".join(r(f"avg({a}*{b})", a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM v GROUP BY label"


def fabrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.principal(_vectors(spark, sf_dir), "label"), 4)


def fold_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.fold_axis(_planes(spark, sf_dir), "region"), 4)


def rose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directional.rose_bins(_planes(spark, sf_dir))


ROSE = "WITH b AS (SELECT CAST(floor((strike % 180)/10) AS INTEGER) AS b, count(*) AS n FROM fx_att GROUP BY 1) SELECT CAST(i*10 AS INTEGER) AS start, coalesce(n, 0) AS n FROM range(0, 36) g(i) LEFT JOIN b ON b.b = i % 18"


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planes(spark, sf_dir)
    trend, plunge = angles.pole("strike", "dip")
    x, y, z = angles.line_vector(trend, plunge)
    u, v = angles.equal_area(trend, plunge)
    p = p.select("id", trend.alias("trend"), plunge.alias("plunge"), x.alias("x"), y.alias("y"), z.alias("z"), u.alias("u"), v.alias("v"))
    return comparable(p.withColumn("inside", directional.inside(F.col("u"), F.col("v"), OUTLINE)))


_CROSS = "+".join(f"CAST((({y1} > v) <> ({y2} > v)) AND u < {x1} + (v - ({y1}))*{(x2 - x1) / (y2 - y1)!r} AS INTEGER)" for (x1, y1), (x2, y2) in zip(OUTLINE, [*OUTLINE[1:], OUTLINE[0]], strict=True) if y1 != y2)
PROJECTIONS = f"""WITH p AS (SELECT id, (strike+270) % 360 AS t, 90-dip AS q FROM fx_att), w AS (SELECT *, sqrt(greatest(1-sin(radians(q)), 0))*sin(radians(t)) AS u, sqrt(greatest(1-sin(radians(q)), 0))*cos(radians(t)) AS v FROM p)
 SELECT id, {r('t', 'trend')}, {r('q', 'plunge')}, {r('cos(radians(q))*sin(radians(t))', 'x')}, {r('cos(radians(q))*cos(radians(t))', 'y')}, {r('-sin(radians(q))', 'z')}, {r('u', 'u')}, {r('v', 'v')}, ({_CROSS}) % 2 = 1 AS inside FROM w"""


def great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(directional.great_circles(_planes(spark, sf_dir)))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _planes(spark, sf_dir)
    return directional.linked(p.select("id", "region"), p.where("dip > 80"))


LINKED = "SELECT id, region FROM fx_att WHERE id IN (SELECT id FROM fx_att WHERE dip > 80)"

QUERIES = {
    "x1_projections": (projections, PROJECTIONS),
    "x7_great_circles": (great_circles, None),
    "x9_fisher": (fisher, FISHER),
    "x10_tensors": (tensors, TENSORS),
    "x12_fabrics": (fabrics, None),
    "x14_fold_axes": (fold_axes, None),
    "x15_rose": (rose, ROSE),
    "x18_linked": (linked, LINKED),
}
