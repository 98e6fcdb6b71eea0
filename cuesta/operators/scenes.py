"""Choosing scenes from a catalogue table scenes(aoi, ord, d, cloud); ord is the order in which items came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesta.functions.catalogue import cloud_cover


def thresholds(first: float = 5, ceiling: float = 20) -> list[float]:
    """first, doubled until the ceiling, which ends the list."""
    out = [min(float(first), float(ceiling))]
    while out[-1] < ceiling:
        out.append(min(out[-1] * 2, float(ceiling)))
    return out


def clear_scenes(scenes: DataFrame, first: float = 5, ceiling: float = 20) -> DataFrame:
    """scenes with threshold: those strictly below the lowest threshold that leaves any, for each aoi."""
    steps = F.array(*(F.lit(t) for t in thresholds(first, ceiling)))
    least = scenes.groupBy("aoi").agg(F.min(cloud_cover("cloud")).alias("_c"))
    limit = least.select("aoi", F.array_min(F.filter(steps, lambda t: t > F.col("_c"))).alias("threshold")).where("threshold is not null")
    return scenes.join(limit, "aoi").where(cloud_cover("cloud") < F.col("threshold"))


def least_cloudy(scenes: DataFrame) -> DataFrame:
    """The clearest scene of each aoi, the first of equals."""
    best = F.min_by(F.struct(*scenes.columns), F.struct(cloud_cover("cloud"), "ord"))
    return scenes.groupBy("aoi").agg(best.alias("_b")).select("_b.*")


def monthly_cloud(scenes: DataFrame) -> DataFrame:
    """(aoi, month, n, min_cloud, median_cloud)."""
    c = cloud_cover("cloud")
    return scenes.groupBy("aoi", F.month("d").alias("month")).agg(F.count("*").alias("n"), F.min(c).alias("min_cloud"), F.median(c).alias("median_cloud"))


def clearest_months(scenes: DataFrame, top: int = 3, most: float = 5) -> DataFrame:
    """(aoi, place, month, n): the months with most clear scenes, earlier months first among equals."""
    counted = scenes.where(cloud_cover("cloud") <= most).groupBy("aoi", F.month("d").alias("month")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("aoi").orderBy(F.desc("n"), "month")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("aoi", "place", "month", "n")


def pick_scene(scenes: DataFrame, months: Sequence[int] = ()) -> DataFrame:
    """One scene for each aoi: preferred months first, then the clearest, then the first."""
    liked = F.when(F.month("d").isin(*months), 0).otherwise(1) if months else F.lit(0)
    best = F.min_by(F.struct(*scenes.columns), F.struct(liked, cloud_cover("cloud"), "ord"))
    return scenes.groupBy("aoi").agg(best.alias("_b")).select("_b.*")


def coverage(footprints: DataFrame, box: Sequence[float], n: int = 120, *keys: str) -> DataFrame:
    """(keys, cover): the share of an n x n lattice over the box that lies in a footprint(x0, y0, x1, y1), edges included.

    A footprint covers a run of lattice columns and of rows, so points come from two sequences
    rather than from a range join; n * n points a key bound the result.
    """
    def run(lo: str, hi: str, a: float, b: float):
        step = (b - a) / (n - 1)
        # the lattice's own coordinates decide, so that its edges count as numpy's linspace would place them
        return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.lit(a) + k * F.lit(step) >= F.col(lo)) & (F.lit(a) + k * F.lit(step) <= F.col(hi)))

    at = footprints.select(*keys, F.explode(run("x0", "x1", float(box[0]), float(box[2]))).alias("i"), run("y0", "y1", float(box[1]), float(box[3])).alias("js"))
    cells = at.select(*keys, "i", F.explode("js").alias("j")).distinct().groupBy(*keys).agg((F.count("*") / (n * n)).alias("cover"))
    if not keys:
        return cells
    return footprints.select(*keys).distinct().join(cells, list(keys), "left").select(*keys, F.coalesce("cover", F.lit(0.0)).alias("cover"))


def best_date(footprints: DataFrame, box: Sequence[float], n: int = 120) -> DataFrame:
    """(d, cover) of the day whose footprints(ord, d, x0, y0, x1, y1) cover most; the first in order of equals."""
    first = footprints.groupBy("d").agg(F.min("ord").alias("ord"))
    return coverage(footprints, box, n, "d").join(first, "d").orderBy(F.desc("cover"), "ord").limit(1).select("d", "cover")
