"""Reading, laying together and writing, over relations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions import catalogue as names
from cuesta.functions.grid import pixels_to_world, world_cell
from cuesta.functions.numeric import finite, nan
from cuesta.operators import scenes
from cuesta.operators.normalise import gdal_cells
from cuesta.plans.attitudes import GT
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables
from cuesta.sources import catalogue, rasters, traces

FINE = (5.0, 16.0, 0.0, 470.0, 0.0, -16.0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over a table of items: boxes that meet, times, cloud, the first hundred."""
    t = tables(spark, sf_dir)["fx_scene"].select("ord", F.date_format("d", "yyyy-MM-dd").alias("datetime"), "cloud", F.expr("array(cast(ord % 97 AS double), cast(ord % 89 AS double), cast(ord % 97 + 3 AS double), cast(ord % 89 + 3 AS double))").alias("bbox"))
    return catalogue.overlapping(t, (10, 10, 30, 30), "1993", "1997", 50.0, 100).select("ord", "datetime", "cloud")


ITEMS = "SELECT ord, strftime(d, '%Y-%m-%d') AS datetime, cloud FROM fx_scene WHERE ord%97 <= 30 AND ord%97+3 >= 10 AND ord%89 <= 30 AND ord%89+3 >= 10 AND strftime(d, '%Y-%m-%d') >= '1993' AND strftime(d, '%Y-%m-%d') <= '1997' AND cloud < 50 ORDER BY ord LIMIT 100"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)["fx_scene"]
    return t.select("ord", names.item_month(F.date_format("d", "yyyy-MM-dd")).cast("long").alias("month"), names.cloud_cover(F.when(F.col("ord") % 5 > 0, F.col("cloud"))).alias("cloud"))


MONTHS = "SELECT ord, month(d) AS month, CASE WHEN ord % 5 > 0 THEN cloud ELSE 100 END AS cloud FROM fx_scene"


def mosaicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources on one lattice, the second only on every third cell, clipped to a box."""
    x, y = pixels_to_world("r", "c", GT)
    dem = tables(spark, sf_dir)["fx_dem"].withColumn("x", x).withColumn("y", y)
    over = dem.withColumn("z", F.when((F.col("r") + F.col("c")) % 3 == 0, F.col("z") + 1).otherwise(nan()))
    both = dem.withColumn("source", F.lit(0)).unionByName(over.withColumn("source", F.lit(1)))
    return comparable(rasters.clipped(rasters.mosaic(both), (100, 50, 305, 400)).select("r", "c", "z"))


MOSAICKED = f"SELECT r, c, {r('CASE WHEN (r+c)%3 = 0 THEN z+1 ELSE z END', 'z')} FROM fx_dem WHERE c*10+5 BETWEEN 100 AND 305 AND 480-(r*10+5) BETWEEN 50 AND 400"


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem, target = tables(spark, sf_dir)["fx_dem"], rasters.lattice(spark, 29, 29)
    smooth = rasters.aligned(dem, GT, target, FINE)
    near = rasters.aligned(dem, GT, target, FINE, nearest=True).withColumnRenamed("z", "near")
    return comparable(smooth.join(near, ["grid_id", "r", "c"]).drop("grid_id"), 5)


ALIGNED = f"""WITH t AS (SELECT CAST(a.range AS INTEGER) AS r, CAST(b.range AS INTEGER) AS c, 5+(b.range+0.5)*16 AS x, 470-(a.range+0.5)*16 AS y FROM range(29) a, range(29) b), p AS (SELECT *, ((y-480)*10)/(-100)-0.5 AS pr, (x*(-10))/(-100)-0.5 AS pc FROM t),
 q AS (SELECT *, CAST(floor(pr) AS INTEGER) AS r0, CAST(floor(pc) AS INTEGER) AS c0 FROM p), s AS (SELECT q.r, q.c, (a.z+(e.z-a.z)*(pc-c0))+((f.z+(g.z-f.z)*(pc-c0))-(a.z+(e.z-a.z)*(pc-c0)))*(pr-r0) AS z, n.z AS near FROM q
 LEFT JOIN fx_dem a ON a.r=r0 AND a.c=c0 LEFT JOIN fx_dem e ON e.r=r0 AND e.c=c0+1 LEFT JOIN fx_dem f ON f.r=r0+1 AND f.c=c0 LEFT JOIN fx_dem g ON g.r=r0+1 AND g.c=c0+1 LEFT JOIN fx_dem n ON n.r=CAST(floor(pr+0.5) AS INTEGER) AND n.c=CAST(floor(pc+0.5) AS INTEGER))
 SELECT r, c, {r('z', 'z', 5)}, {r('near', 'near', 5)} FROM s"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scenes.coverage(_footprints(spark, sf_dir), (0.0, 0.0, 19.0, 19.0), 20, "aoi"))


def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_scene"].selectExpr("ord", "aoi", "d", "cast((ord * 13) % 400 AS double) AS x0", "cast((ord * 13) % 400 + 4 AS double) AS x1", "cast((ord * 7) % 100 AS double) AS y0", "cast((ord * 7) % 100 + 6 AS double) AS y1")


_FEET = "f AS (SELECT ord, aoi, d, (ord*13)%400 AS x0, (ord*13)%400+4 AS x1, (ord*7)%100 AS y0, (ord*7)%100+6 AS y1 FROM fx_scene), l AS (SELECT a.range AS x, b.range AS y FROM range(20) a, range(20) b)"
COVERED = f"WITH {_FEET}, h AS (SELECT DISTINCT aoi, x, y FROM f JOIN l ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), n AS (SELECT aoi, count(*)/400 AS cover FROM h GROUP BY aoi) SELECT a.aoi, {r('coalesce(n.cover, 0)', 'cover')} FROM (SELECT DISTINCT aoi FROM f) a LEFT JOIN n USING (aoi)"


def best_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scenes.best_date(_footprints(spark, sf_dir), (0.0, 0.0, 19.0, 19.0), 20).withColumn("d", F.date_format("d", "yyyy-MM-dd")))


BEST_DAY = f"WITH {_FEET}, h AS (SELECT DISTINCT d, x, y FROM f JOIN l ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), n AS (SELECT d, count(*)/400 AS cover FROM h GROUP BY d), o AS (SELECT d, min(ord) AS ord FROM f GROUP BY d) SELECT strftime(d, '%Y-%m-%d') AS d, {r('cover', 'cover')} FROM n JOIN o USING (d) ORDER BY n.cover DESC, ord LIMIT 1"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and multi-lines as text, split into traces; the accepted ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    one = "concat('[[', o_orderkey, ',', o_custkey, '],[', o_orderkey + 1, ',', o_custkey + 2, ',7]]')"
    f = o.selectExpr("'f' AS file", "o_orderkey AS feature", "CASE WHEN o_orderkey % 2 = 0 THEN 'LineString' ELSE 'MultiLineString' END AS type", f"CASE WHEN o_orderkey % 2 = 0 THEN {one} ELSE concat('[', {one}, ',[[1,2]],', {one}, ']') END AS coordinates", "CASE o_orderkey % 5 WHEN 0 THEN 'drainage' WHEN 1 THEN 'contact' WHEN 2 THEN 'reject' END AS class")
    return traces.traces(f).where(traces.accepted()).select("feature", "part", "seq", "x", "y", "class")


PARTS = """SELECT o_orderkey AS feature, p AS part, s AS seq, CAST(o_orderkey + s AS DOUBLE) AS x, CAST(o_custkey + 2*s AS DOUBLE) AS y, CASE WHEN o_orderkey % 5 = 1 THEN 'contact' END AS class FROM orders, (VALUES (0), (2)) a(p), (VALUES (0), (1)) b(s) WHERE (o_orderkey % 2 = 1 OR p = 0) AND o_orderkey % 5 NOT IN (0, 2)"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)["fx_att"].withColumn("selected", F.col("dip") > 60).withColumn("class", F.expr("CASE id % 4 WHEN 0 THEN 'drainage' WHEN 1 THEN 'contact' END"))
    return traces.layer_scan(t, traces.accepted()).select("id", "class")


SCANNED = "SELECT id, CASE WHEN id % 4 = 1 THEN 'contact' END AS class FROM fx_att WHERE dip > 60 AND id % 4 <> 0"


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights as they are written, nodata included."""
    return tables(spark, sf_dir)["fx_dem"].select("r", "c", gdal_cells("z").cast("double").alias("value"))


STORED = "SELECT r, c, CASE WHEN isfinite(z) THEN z ELSE -9999 END AS value FROM fx_dem"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)["fx_att"]
    return traces.formatted(t.select("id", "x", "y", "strike", "dip", (F.col("dip") > 45).alias("reliable")))


TEXTS = "SELECT CAST(id AS VARCHAR) AS id, " + ", ".join(f"printf('%.{d}f', {c}) AS {c}" for c, d in (("x", 1), ("y", 1), ("strike", 2), ("dip", 2))) + ", CASE WHEN dip > 45 THEN '1' ELSE '0' END AS reliable FROM fx_att"


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that hold the traces' vertices, and those pixels' centres."""
    v = tables(spark, sf_dir)["fx_vert"]
    rr, cc = world_cell("x", "y", GT)
    at = v.select("trace_id", "seq", rr.alias("r"), cc.alias("c"))
    x, y = pixels_to_world("r", "c", GT)
    return at.select("trace_id", "seq", "r", "c", x.alias("x"), y.alias("y"))


CELLS_OF = "WITH p AS (SELECT trace_id, seq, CAST(floor(((y-480)*10)/(-100)) AS INTEGER) AS r, CAST(floor((x*(-10))/(-100)) AS INTEGER) AS c FROM fx_vert) SELECT trace_id, seq, r, c, c*10+5.0::DOUBLE AS x, 480-(r*10+5.0::DOUBLE) AS y FROM p"


def known_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid statistics of what a written table holds again after reading: cells and known cells."""
    t = tables(spark, sf_dir)["fx_dem"]
    return t.groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if(finite("z")).alias("known"))


KNOWN = "SELECT grid_id, count(*) AS n, count(*) FILTER (isfinite(z)) AS known FROM fx_dem GROUP BY grid_id"

QUERIES = {
    "s2_search": (items, ITEMS),
    "s5_months": (months, MONTHS),
    "s7_mosaic": (mosaicked, MOSAICKED),
    "s13_known": (known_share, KNOWN),
    "s14_parts": (parts, PARTS),
    "s15_layer": (scanned, SCANNED),
    "s17_coverage": (covered, COVERED),
    "s18_best_day": (best_day, BEST_DAY),
    "k1_cells": (stored_cells, STORED),
    "k5_texts": (texts, TEXTS),
    "p2_cells": (cells_of, CELLS_OF),
    "p6_aligned": (aligned, ALIGNED),
}
