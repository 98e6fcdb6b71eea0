"""Polylines as points: trace_pts(trace_id, seq, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuesta.functions.grid import Transform, world_to_pixels
from cuesta.functions.numeric import nan, finite, half_even, modulo


def along() -> WindowSpec:
    return Window.partitionBy("trace_id").orderBy("seq")


def segments(points: DataFrame) -> DataFrame:
    """One row per segment: trace_id, seq, (x, y) to (x2, y2) and its length."""
    out = points.select("trace_id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = out.withColumn("x2", F.lead("x").over(along())).withColumn("y2", F.lead("y").over(along())).where("x2 is not null")
    return out.withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))


def lengths(points: DataFrame) -> DataFrame:
    """(trace_id, length); a trace of one point has length 0."""
    step = F.hypot(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along()))
    return points.withColumn("_d", step).groupBy("trace_id").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def densify(points: DataFrame, spacing: float) -> DataFrame:
    """(trace_id, seq, k, x, y): each segment cut into equal steps of at most ``spacing``, after the first vertex (k = 0).

    Traces of fewer than two points give nothing.
    """
    if spacing <= 0:
        raise ValueError("the spacing must be positive")
    s = segments(points).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / float(spacing)).cast("int")))
    first = F.col("seq") == F.min("seq").over(Window.partitionBy("trace_id"))
    s = s.withColumn("from", F.when(first, F.lit(0)).otherwise(F.lit(1)))
    steps = F.sequence(F.col("from"), F.col("n"))
    t = F.col("k") / F.col("n")
    return s.select("*", F.explode(steps).alias("k")).select("trace_id", "seq", "k", (F.col("x") + (F.col("x2") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * t).alias("y"))


def stepped(points: DataFrame, spacing: float) -> DataFrame:
    """``densify`` with (_dx, _dy), the way from the point before to the one after, or from or to the point itself at an end.

    The neighbours come from the segments, so windows run over the vertices only and the many points are not sorted.
    """
    s = segments(points).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / float(spacing)).cast("int")))

    def at(c: str, t: Column) -> Column:
        return F.col(c) + (F.col(f"{c}2") - F.col(c)) * t

    one = F.lit(1.0)
    ends = {f"{c}0": F.lag(at(c, one)).over(along()) for c in ("x", "y")} | {f"{c}3": F.lead(at(c, one / F.col("n"))).over(along()) for c in ("x", "y")}
    s = s.withColumns({**ends, "from": F.when(F.lag("seq").over(along()).isNull(), F.lit(0)).otherwise(F.lit(1))})
    s = s.select("*", F.explode(F.sequence(F.col("from"), F.col("n"))).alias("k"))
    here = {c: at(c, F.col("k") / F.col("n")) for c in ("x", "y")}
    before = {c: F.when(F.col("k") > F.col("from"), at(c, (F.col("k") - 1) / F.col("n"))).otherwise(F.coalesce(f"{c}0", here[c])) for c in ("x", "y")}
    after = {c: F.when(F.col("k") < F.col("n"), at(c, (F.col("k") + 1) / F.col("n"))).otherwise(F.coalesce(f"{c}3", here[c])) for c in ("x", "y")}
    return s.select("trace_id", "seq", "k", here["x"].alias("x"), here["y"].alias("y"), *((after[c] - before[c]).alias(f"_d{c}") for c in ("x", "y")))


def quads(pixels: DataFrame, z: str = "z") -> DataFrame:
    """(grid_id, r0, c0, z00, z01, z10, z11): each pixel with its neighbours east, south and south-east."""
    row = Window.partitionBy("grid_id", "r").orderBy("c")
    column = Window.partitionBy("grid_id", "c").orderBy("r")
    out = pixels.select("grid_id", "r", "c", F.col(z).alias("z00")).withColumn("z01", F.lead("z00").over(row))
    below = F.lead(F.struct("z00", "z01")).over(column)
    return out.withColumn("_b", below).select("grid_id", F.col("r").alias("r0"), F.col("c").alias("c0"), "z00", "z01", F.col("_b.z00").alias("z10"), F.col("_b.z01").alias("z11"))


def sample_bilinear(points: DataFrame, pixels: DataFrame, gt: Transform, z: str = "z") -> DataFrame:
    """points(x, y, ...) with z from four pixels around; NaN outside the ring of pixel centres or if a pixel is nodata.

    Points carry a grid_id if pixels hold several grids; else all refer to the one grid.
    """
    r, c = world_to_pixels("x", "y", gt)
    at = points.withColumn("_r", r).withColumn("_c", c).withColumn("r0", F.floor("_r").cast("int")).withColumn("c0", F.floor("_c").cast("int"))
    q = quads(pixels, z)
    on = ["r0", "c0"]
    if "grid_id" in points.columns:
        on.append("grid_id")
    else:
        q = q.drop("grid_id")
    fr, fc = F.col("_r") - F.col("r0"), F.col("_c") - F.col("c0")
    top = F.col("z00") + (F.col("z01") - F.col("z00")) * fc
    low = F.col("z10") + (F.col("z11") - F.col("z10")) * fc
    value = F.coalesce(top + (low - top) * fr, nan())
    return at.join(q, on, "left").select(*points.columns, value.alias("z"))


def sample_trace(points: DataFrame, pixels: DataFrame, gt: Transform, spacing: float) -> DataFrame:
    """(trace_id, seq, k, x, y, z) of the densified traces where the surface is known."""
    return sample_bilinear(densify(points, spacing), pixels, gt).where(finite("z"))


def lookup_cells(points: DataFrame, height: int, width: int) -> DataFrame:
    """points(x: column, y: row) with the nearest pixel (r, c), clipped to the grid."""
    r = F.least(F.greatest(half_even("y"), F.lit(0)), F.lit(height - 1))
    c = F.least(F.greatest(half_even("x"), F.lit(0)), F.lit(width - 1))
    return points.withColumn("r", r).withColumn("c", c)


def sample_along(points: DataFrame, pixels: DataFrame, height: int, width: int, z: str = "z") -> DataFrame:
    """(trace_id, seq, k, v): finite nearest-pixel values at one-pixel steps of pixel-space traces."""
    cells = lookup_cells(densify(points, 1.0), height, width)
    return cells.join(pixels.select("r", "c", F.col(z).alias("v")), ["r", "c"]).where(finite("v")).select("trace_id", "seq", "k", "v")


def per_trace(samples: DataFrame, least: int = 5) -> DataFrame:
    """(trace_id, n, mean, median) of v; NaN with fewer than ``least`` samples."""
    out = samples.groupBy("trace_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"))
    return out.select("trace_id", "n", *(F.when(F.col("n") >= least, F.col(c)).otherwise(nan()).alias(c) for c in ("mean", "median")))


def burn(points: DataFrame, height: int, width: int) -> DataFrame:
    """Distinct pixels (r, c) that pixel-space traces pass at one-pixel steps, within the grid."""
    d = densify(points, 1.0).select(half_even("y").alias("r"), half_even("x").alias("c"))
    return d.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)).distinct()


def straight_pixels(lines: DataFrame) -> DataFrame:
    """(id, k, r, c): pixels of the straight line from (r1, c1) to (r2, c2), halves rounded to even."""
    n = F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1"))).cast("int")
    t = F.when(n > 0, F.col("k") / F.when(n > 0, n)).otherwise(F.lit(0.0))
    out = lines.select("*", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return out.select("id", "k", half_even(F.col("r1") + (F.col("r2") - F.col("r1")) * t).alias("r"), half_even(F.col("c1") + (F.col("c2") - F.col("c1")) * t).alias("c"))


def orientation(dx: Column, dy: Column) -> Column:
    """Undirected orientation in [0, 180); 0 for a zero vector."""
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(modulo(F.degrees(F.atan2(dx, dy)), 180))


def end_tangents(points: DataFrame, n: int = 4) -> DataFrame:
    """(trace_id, end, x, y, dx, dy): both ends of each trace with the outward heading over up to n vertices."""
    forward = Window.partitionBy("trace_id").orderBy("seq")
    both = None
    for end, order in ((0, forward), (1, Window.partitionBy("trace_id").orderBy(F.desc("seq")))):
        ranked = points.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
        tip = ranked.groupBy("trace_id").agg(F.min_by(F.struct("x", "y"), "_k").alias("a"), F.max_by(F.struct("x", "y"), "_k").alias("b"), F.count("*").alias("m")).where("m > 1")
        part = tip.select("trace_id", F.lit(end).alias("end"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), (F.col("a.x") - F.col("b.x")).alias("dx"), (F.col("a.y") - F.col("b.y")).alias("dy"))
        both = part if both is None else both.union(part)
    return both
