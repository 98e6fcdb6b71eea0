"""From a surface to traces and attitudes: detect, flag drainage, link what is kept, fit planes.

The chain works on one grid of known size; its steps are the operators of the
other modules, each a DataFrame.  Linking comes after drainage is taken out, so
that fragments of creeks are not rejoined.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesta.functions.grid import Transform, pixels_to_world
from cuesta.functions.numeric import clip, finite
from cuesta.operators.attitude import fit_traces
from cuesta.operators.edges import detected
from cuesta.operators.fixpoint import settled
from cuesta.operators.hydrology import flag_drainage
from cuesta.operators.polyline import lengths
from cuesta.operators.stencils import terrain_stack
from cuesta.operators.tracing import link_polylines

BANDS = ("profile_curvature", "curvature", "slope")


class Detection(NamedTuple):
    """traces and linked hold pixel-space points (trace_id, seq, x, y); flags has a row for each trace."""

    traces: DataFrame
    flags: DataFrame
    kept: DataFrame
    linked: DataFrame


def detect_and_link(pixels: DataFrame, height: int, width: int, res: float = 30.0, bands: Sequence[str] = BANDS, min_points: int = 8, tolerance: float = 1.0, downsample: int = 3, least: int = 15, overlap: float = 0.5, detector: str = "classical") -> Detection:
    stack = settled(terrain_stack(pixels, res, list(bands)))
    traces = settled(detected(detector, stack, list(bands), min_length=min_points, tolerance=tolerance).drop("grid_id"))
    flags = settled(flag_drainage(traces, pixels, height, width, downsample, least, min_overlap=overlap))
    kept = traces.join(flags.where("NOT is_drainage").select("trace_id"), "trace_id", "left_semi")
    return Detection(traces, flags, kept, settled(link_polylines(kept)))


def to_world(points: DataFrame, gt: Transform) -> DataFrame:
    """Pixel-space points (x: column, y: row) in world coordinates."""
    x, y = pixels_to_world("y", "x", gt)
    return points.withColumn("_x", x).withColumn("_y", y).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def detect_traces(pixels: DataFrame, gt: Transform, height: int, width: int, **options) -> tuple[DataFrame, DataFrame]:
    """(candidates, their world points): trace_id, is_drainage, score, rank, length.

    Kept and linked traces score 1 with rank 0; flagged ones score what is not monotonic and keep their rank.
    """
    d = detect_and_link(pixels, height, width, **options)
    flagged = d.traces.join(d.flags.where("is_drainage").select("trace_id"), "trace_id", "left_semi")
    kept = to_world(d.linked, gt).withColumn("trace_id", F.concat(F.lit("kept:"), "trace_id"))
    creeks = to_world(flagged, gt).withColumn("trace_id", F.concat(F.lit("flagged:"), "trace_id"))
    points = settled(kept.select("trace_id", "seq", "x", "y").union(creeks.select("trace_id", "seq", "x", "y")))
    mono = F.when(finite("monotonicity"), F.col("monotonicity")).otherwise(1.0)
    scored = d.flags.where("is_drainage").select(F.concat(F.lit("flagged:"), "trace_id").alias("trace_id"), clip(1 - mono, 0, 1).alias("score"), "rank")
    out = lengths(points).join(scored, "trace_id", "left")
    return out.select("trace_id", F.col("score").isNotNull().alias("is_drainage"), F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("rank", F.lit(0.0)).alias("rank"), "length"), points


def detect_attitudes(pixels: DataFrame, gt: Transform, height: int, width: int, res: float = 30.0, sigma_z: float | None = 2.0, min_points: int = 8, conditioning: float = 1e-2, map_conditioning: float = 1e-3, **options) -> tuple[Detection, DataFrame]:
    """The detection and the attitudes of its kept, linked traces."""
    d = detect_and_link(pixels, height, width, res=res, min_points=min_points, **options)
    world = to_world(d.linked, gt)
    numbers = settled(world.select("trace_id").distinct().withColumn("n", F.xxhash64("trace_id")))
    numbered = world.join(numbers, "trace_id").select(F.col("n").alias("trace_id"), "seq", "x", "y")
    fits = fit_traces(numbered, pixels, gt, res, sigma_z, min_points, conditioning, map_conditioning)
    return d, fits.join(numbers.select(F.col("trace_id").alias("trace"), F.col("n").alias("trace_id")), "trace_id").drop("trace_id").withColumnRenamed("trace", "trace_id")
