"""Catalogue queries over the derived scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions import catalogue
from cuesta.operators import scenes
from cuesta.plans.compare import comparable, r
from cuesta.plans.fixtures import tables


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["fx_scene"]


def clear_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.clear_scenes(_scenes(spark, sf_dir)).select("aoi", "ord", "threshold")


CLEAR = """WITH t(t) AS (VALUES (5.0::DOUBLE), (10), (20)), m AS (SELECT aoi, min(cloud) AS c FROM fx_scene GROUP BY aoi), l AS (SELECT aoi, min(t) AS t FROM m JOIN t ON t > c GROUP BY aoi)
 SELECT s.aoi, s.ord, l.t AS threshold FROM fx_scene s JOIN l ON s.aoi = l.aoi AND s.cloud < l.t"""


def least_cloudy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.least_cloudy(_scenes(spark, sf_dir)).select("aoi", "ord", "cloud")


LEAST = "SELECT aoi, ord, cloud FROM fx_scene QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY cloud, ord) = 1"


def monthly_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(scenes.monthly_cloud(_scenes(spark, sf_dir)).withColumn("month", F.col("month").cast("long")))


MONTHLY = f"SELECT aoi, month(d) AS month, count(*) AS n, {r('min(cloud)', 'min_cloud')}, {r('quantile_cont(cloud, 0.5)', 'median_cloud')} FROM fx_scene GROUP BY 1, 2"


def clearest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scenes.clearest_months(_scenes(spark, sf_dir))
    return out.select("aoi", F.col("place").cast("long").alias("place"), F.col("month").cast("long").alias("month"), "n")


CLEAREST = "WITH m AS (SELECT aoi, month(d) AS month, count(*) AS n FROM fx_scene WHERE cloud <= 5 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY n DESC, month) AS place FROM m) SELECT aoi, place, month, n FROM p WHERE place <= 3"


def pick_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.pick_scene(_scenes(spark, sf_dir), [3, 4]).select("aoi", "ord", "cloud")


PICK = "SELECT aoi, ord, cloud FROM fx_scene QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY CASE WHEN month(d) IN (3, 4) THEN 0 ELSE 1 END, cloud, ord) = 1"


def item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals, addresses, zones and names made from each scene."""
    s = _scenes(spark, sf_dir)
    day = F.date_format("d", "yyyy-MM-dd")
    box = [(F.col("ord") % 340 - 170).cast("double"), (F.col("aoi") * 4 - 40).cast("double")]
    box += [box[0] + 0.5, box[1] + 0.25]
    token = F.when(F.col("ord") % 3 == 0, day).when(F.col("ord") % 3 == 1, F.concat(day, F.lit("/.."))).otherwise(F.concat(day, F.lit("T10:00:00Z")))
    href = F.concat(F.when(F.col("ord") % 2 == 0, "s3://b/").otherwise("https://h/"), F.col("ord").cast("string"))
    return s.select("ord", catalogue.normalize_datetime(token).alias("span"), catalogue.item_month(day).alias("month"), catalogue.to_vsicurl(href).alias("address"), catalogue.utm_epsg(*box).alias("epsg"), catalogue.group_name(*box).alias("name"), catalogue.oversized(*box).alias("oversized"))


_DAY = "strftime(d, '%Y-%m-%d')"
ITEM_TEXT = f"""WITH s AS (SELECT ord, d, (ord % 340 - 170)::DOUBLE + 0.25 AS lon, (aoi*4 - 40)::DOUBLE + 0.125 AS lat FROM fx_scene)
 SELECT ord, CASE ord % 3 WHEN 0 THEN {_DAY} || 'T00:00:00Z/' || {_DAY} || 'T23:59:59Z' WHEN 1 THEN {_DAY} || 'T00:00:00Z/..' ELSE {_DAY} || 'T10:00:00Z' END AS span, CAST(month(d) AS INTEGER) AS month,
 CASE WHEN ord % 2 = 0 THEN '/vsis3/b/' ELSE '/vsicurl/https://h/' END || ord AS address,
 CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon+180)/6)+1, 1), 60) AS INTEGER) AS epsg,
 format('{{:.3f}}', abs(lat)) || CASE WHEN lat >= 0 THEN 'N ' ELSE 'S ' END || format('{{:.3f}}', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS name, false AS oversized FROM s"""

QUERIES = {
    "s9_clear_scenes": (clear_scenes, CLEAR),
    "s4_item_text": (item_text, ITEM_TEXT),
    "g1_least_cloudy": (least_cloudy, LEAST),
    "g2_monthly_cloud": (monthly_cloud, MONTHLY),
    "g3_clearest_months": (clearest_months, CLEAREST),
    "g4_pick_scene": (pick_scene, PICK),
}
