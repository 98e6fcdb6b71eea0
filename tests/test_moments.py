"""Planes of traces: what their plans hold, and coordinates far from the origin."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cuesta.operators import attitude


def samples(spark, far=0.0):
    rows = spark.range(300).select((F.col("id") % 10).alias("trace_id"), F.col("id").alias("seq"), F.lit(0).alias("k"), (far + F.col("id") % 17).alias("x"), (far + F.col("id") % 13).alias("y"))
    return rows.withColumn("z", 3.0 * (F.col("x") - far) + 4.0 * (F.col("y") - far) + F.col("seq") % 3)


@pytest.mark.parametrize("of", [attitude.fit_planes, attitude.map_shapes])
def test_samples_are_not_held_in_a_window(spark, of):
    text = io.StringIO()
    with redirect_stdout(text):
        of(samples(spark)).explain()
    assert "Window" not in text.getvalue()


def test_far_coordinates_do_not_cancel(spark):
    near, far = ({r.trace_id: r for r in attitude.fit_planes(samples(spark, at)).collect()} for at in (0.0, 5e6))
    shapes = {r.trace_id: r for r in attitude.map_shapes(samples(spark)).collect()}
    assert near.keys() == far.keys() == shapes.keys()
    for k, r in near.items():
        assert [far[k][c] for c in attitude.FIT_COLUMNS] == pytest.approx([r[c] for c in attitude.FIT_COLUMNS], abs=1e-6)
        assert [shapes[k][c] for c in ("n_samples", "relief", "map_conditioning")] == [r[c] for c in ("n_samples", "relief", "map_conditioning")]


def test_more_vertices_are_dealt_over_more_tasks(spark, monkeypatch):
    points = spark.range(1000)
    assert attitude._parts(points) is None
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(attitude, "DEALT", 1)
    assert session >= 1000 or attitude._parts(points) == 1000
