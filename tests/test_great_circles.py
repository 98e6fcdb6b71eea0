"""Great circles come with equal planes together, so that what is written of them stays small."""

from itertools import groupby

from pyspark.sql import functions as F

from cuesta.operators import directional


def circles(planes, n=5):
    """The planes' ids and (strike, dip) in the order of the rows, by partition, each once a run."""
    of = {r.id: (r.strike, r.dip) for r in planes.collect()}
    return [[(of[i], i) for i, _ in groupby(r.id for r in part)] for part in directional.great_circles(planes, n).rdd.glom().collect()]


def test_equal_planes_lie_together(spark):
    planes = spark.range(600).select("id", (F.col("id") * 7 % 20).cast("double").alias("strike"), (F.col("id") % 3).cast("double").alias("dip"))
    parts = [p for p in circles(planes) if p]
    assert sum(map(len, parts)) == 600  # a circle's points stay together as well
    assert sum(len([*groupby(plane for plane, _ in p)]) for p in parts) <= 60 + len(parts) - 1


def test_equal_planes_share_out_over_tasks(spark):
    planes = spark.range(5000).select("id", F.lit(30.0).alias("strike"), F.lit(60.0).alias("dip"))
    sizes = [len(p) for p in circles(planes, 2)]
    assert sum(sizes) == 5000 and max(sizes) < 2500


def test_planes_without_strike_stay(spark):
    planes = spark.createDataFrame([(1, None, 10.0), (2, float("nan"), 10.0), (3, 0.0, 0.0), (4, 0.0, 0.0)], "id long, strike double, dip double")
    assert sorted((r.id, r.k) for r in directional.great_circles(planes, 3).collect()) == [(i, k) for i in (1, 2, 3, 4) for k in range(3)]


def test_points_of_many_orders_take_few_bytes(spark, tmp_path):
    plane = F.col("id") % 1000
    planes = spark.range(0, 10000, 1, 1).select("id", (plane * 0.36).alias("strike"), (plane / 12).alias("dip"))
    directional.great_circles(planes).write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * 181 * 10000
