"""Surface drainage on long-form grids: steepest descent, accumulation, channels and their nearness."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesta.functions.angles import azimuth
from cuesta.functions.numeric import nan, finite, known, or_nan
from cuesta.operators.fixpoint import settled
from cuesta.operators.regions import AT, dilate, distance
from cuesta.operators.stencils import nine
from cuesta.operators.tiles import SIZE, wave, windows

#: Steps in the order that breaks ties, with their place among z1..z9.
STEPS = [(-1, -1, 1), (-1, 0, 2), (-1, 1, 3), (0, -1, 4), (0, 1, 6), (1, -1, 7), (1, 0, 8), (1, 1, 9)]


def flow_directions(pixels: DataFrame) -> DataFrame:
    """(grid_id, r, c, z, dr, dc): the step of steepest strict descent, the first of equals; NULL at sinks and nodata."""
    p = nine(pixels.select(*AT, "z"), outside=nan())
    options = [F.struct(((F.col("z5") - F.col(f"z{k}")) / (math.sqrt(2) if i and j else 1.0)).alias("drop"), F.lit(-n).alias("o"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j, k) in enumerate(STEPS)]
    best = F.array_max(F.filter(F.array(*options), lambda s: ~F.isnan(s["drop"]) & (s["drop"] > 0)))
    return p.withColumn("_b", best).select(*AT, "z", F.col("_b.i").alias("dr"), F.col("_b.j").alias("dc"))


def flow_azimuth(directions: DataFrame) -> DataFrame:
    """directions with the compass azimuth of the step; NaN where there is none."""
    return directions.withColumn("azimuth", or_nan(azimuth(F.col("dc").cast("double"), -F.col("dr").cast("double"))))


def flow_accumulation(directions: DataFrame, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, accumulation) of directions(grid_id, r, c, z, dr, dc) without cycles: the cell and everything upstream; nodata 0.

    Tiles add up on their own and pass on what drains through their borders, until nothing changes; an outlet's
    cells never meet in one task.
    """
    from cuesta.operators.kernels import accumulated

    def solve(of, around, place):
        return accumulated(of["dr"], of["dc"], np.isfinite(of["z"]), around)

    cells = directions.select(*AT, "z", *(F.col(c).cast("double").alias(c) for c in ("dr", "dc")))
    names = ["z", "dr", "dc"]
    return wave(settled(windows(cells, names, size)), names, solve, 0.0, size, lambda of, around, state, place: {"accumulation": state.astype(np.int64)}, {"accumulation": "long"})


def block_mean(pixels: DataFrame, factor: int) -> DataFrame:
    """(grid_id, r, c, z): mean of the finite cells of whole factor x factor blocks; factor 1, or one too large, changes nothing."""
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    sizes = pixels.groupBy("grid_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    p = pixels.select(*AT, "z").join(sizes, "grid_id")
    f = F.when((F.col("h") >= factor) & (F.col("w") >= factor), F.lit(factor)).otherwise(F.lit(1))
    p = p.withColumn("f", f).withColumn("br", F.floor(F.col("r") / F.col("f")).cast("int")).withColumn("bc", F.floor(F.col("c") / F.col("f")).cast("int"))
    whole = ((F.col("br") + 1) * F.col("f") <= F.col("h")) & ((F.col("bc") + 1) * F.col("f") <= F.col("w"))
    out = p.where(whole).groupBy("grid_id", "br", "bc").agg(or_nan(F.avg(known("z"))).alias("z"))
    return out.select("grid_id", F.col("br").alias("r"), F.col("bc").alias("c"), "z")


def upsample(coarse: DataFrame, fine: DataFrame, factor: int) -> DataFrame:
    """fine(grid_id, r, c) with the coarse cell's z; cells past the last whole block take the last."""
    ends = coarse.groupBy("grid_id").agg(F.max("r").alias("_mr"), F.max("c").alias("_mc"))
    at = fine.select(*AT).join(ends, "grid_id")
    at = at.withColumn("_r", F.least(F.floor(F.col("r") / factor).cast("int"), F.col("_mr"))).withColumn("_c", F.least(F.floor(F.col("c") / factor).cast("int"), F.col("_mc")))
    below = coarse.select("grid_id", F.col("r").alias("_r"), F.col("c").alias("_c"), "z")
    return at.join(below, ["grid_id", "_r", "_c"]).select(*AT, "z")


def channels(pixels: DataFrame, least: int = 200) -> DataFrame:
    """(grid_id, r, c, accumulation, azimuth) of cells that drain ``least`` cells or more."""
    directions = flow_directions(pixels)
    held = flow_accumulation(directions).where(F.col("accumulation") >= least)
    return held.join(flow_azimuth(directions).select(*AT, "azimuth"), AT)


def channel_proximity(pixels: DataFrame, mask: DataFrame, buffer: float = 2) -> DataFrame:
    """(grid_id, r, c, near, azimuth): whether a channel lies within the buffer, and the nearest channel's azimuth."""
    near = distance(pixels, mask)
    flow = mask.select("grid_id", F.col("r").alias("near_r"), F.col("c").alias("near_c"), "azimuth")
    inside = dilate(mask, buffer).withColumn("near", F.lit(True))
    out = near.join(flow, ["grid_id", "near_r", "near_c"], "left").join(inside, AT, "left")
    return out.select(*AT, F.coalesce("near", F.lit(False)).alias("near"), or_nan(F.col("azimuth")).alias("azimuth"))


def drainage_penalty(pixels: DataFrame, mask: DataFrame, decay: float = 3.0) -> DataFrame:
    """(grid_id, r, c, penalty): exp(-distance / decay); 0 on a grid without channels."""
    return distance(pixels, mask).select(*AT, F.coalesce(F.exp(-F.col("distance") / decay), F.lit(0.0)).alias("penalty"))


def monotonicity(samples: DataFrame) -> DataFrame:
    """(trace_id, monotonicity) of samples(trace_id, seq, z): net over total change of height; NaN below three samples, 1 when flat."""
    from pyspark.sql import Window

    along = Window.partitionBy("trace_id").orderBy("seq")
    s = samples.where(finite("z")).withColumn("_d", F.abs(F.col("z") - F.lag("z").over(along)))
    out = s.groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("_d").alias("up"), F.abs(F.max_by("z", "seq") - F.min_by("z", "seq")).alias("net"))
    share = F.when(F.col("up") > 0, F.col("net") / F.when(F.col("up") > 0, F.col("up"))).otherwise(1.0)
    return out.select("trace_id", F.when(F.col("n") >= 3, share).otherwise(nan()).alias("monotonicity"))


def flow_network(pixels: DataFrame, downsample: int = 1, fill: bool = True, epsilon: float = 1e-4) -> DataFrame:
    """(grid_id, r, c, accumulation, azimuth) on the full grid: block means, filled, routed, and spread back; accumulation is in coarse cells."""
    from cuesta.operators.kernels import fill_depressions

    coarse = block_mean(pixels, downsample) if downsample > 1 else pixels.select(*AT, "z")
    if fill:
        coarse = fill_depressions(coarse, epsilon)
    directions = flow_azimuth(flow_directions(settled(coarse)))
    out = flow_accumulation(directions).join(directions.select(*AT, "azimuth"), AT)
    if downsample == 1:
        return out
    both = settled(out)
    wide = upsample(both.select(*AT, F.struct("accumulation", "azimuth").alias("z")), pixels, downsample)
    return wide.select(*AT, "z.accumulation", "z.azimuth")


def channel_network(pixels: DataFrame, least: int = 200, downsample: int = 1, fill: bool = True) -> DataFrame:
    """(grid_id, r, c, accumulation, azimuth) of the cells that drain ``least`` coarse cells or more."""
    return flow_network(pixels, downsample, fill).where(F.col("accumulation") >= least)


def density_threshold(network: DataFrame, share: float = 0.15) -> DataFrame:
    """(grid_id, least): the accumulation that leaves about ``share`` of the drained cells as channels."""
    return network.where("accumulation > 0").groupBy("grid_id").agg(F.percentile("accumulation", 1 - share).alias("least"))


def drainage_fractions(points: DataFrame, near: DataFrame, height: int, width: int, tolerance: float = 30.0) -> DataFrame:
    """(trace_id, overlap, aligned): the shares of a pixel-space trace near a channel, and near one and along its flow.

    near(r, c, near, azimuth); directions are undirected, taken over both neighbours at one-pixel steps.
    """
    from cuesta.operators.polyline import lookup_cells, stepped

    d = stepped(points, 1.0)
    at = lookup_cells(d, height, width).join(near.select("r", "c", "near", "azimuth"), ["r", "c"], "left")
    turn = F.abs(F.pmod(azimuth(F.col("_dx"), -F.col("_dy")) - F.col("azimuth") + 90, F.lit(180.0)) - 90)
    on = F.coalesce("near", F.lit(False))
    aligned = on & finite("azimuth") & (turn < tolerance)
    return at.groupBy("trace_id").agg(F.avg(on.cast("double")).alias("overlap"), F.avg(F.coalesce(aligned, F.lit(False)).cast("double")).alias("aligned"))


def along_flow(least: float = 0.5):
    """Whether a trace of drainage_fractions runs along the drainage."""
    return F.col("aligned") >= least


def flag_drainage(points: DataFrame, pixels: DataFrame, height: int, width: int, downsample: int = 3, least: int = 15, buffer: float = 2, min_overlap: float = 0.5) -> DataFrame:
    """(trace_id, is_drainage, overlap, aligned, monotonicity, length, rank) of pixel-space traces on one grid; none is dropped.

    The flag goes by overlap; rank is the length times what is not monotonic, so long traces across valleys come first for review.
    """
    from cuesta.operators.polyline import lengths, sample_along

    # Both inputs are read many times; as tables they keep their plans out of each of the stages below, which the driver compiles.
    pixels, points = settled(pixels.select(*AT, "z")), settled(points.select("trace_id", "seq", "x", "y"))
    known = pixels.where(finite("z")).select(*AT)
    mask = settled(channel_network(pixels, least, downsample).join(known, AT, "left_semi"))
    near = settled(channel_proximity(pixels, mask, buffer))
    shares = drainage_fractions(points, near, height, width)
    samples = sample_along(points, pixels, height, width)
    from pyspark.sql import Window

    ordered = samples.withColumn("seq", F.row_number().over(Window.partitionBy("trace_id").orderBy("seq", "k"))).withColumnRenamed("v", "z")
    out = shares.join(monotonicity(ordered), "trace_id", "left").join(lengths(points), "trace_id")
    mono = F.when(finite("monotonicity"), F.col("monotonicity")).otherwise(1.0)
    return out.select("trace_id", (F.col("overlap") >= min_overlap).alias("is_drainage"), "overlap", "aligned", or_nan(F.col("monotonicity")).alias("monotonicity"), "length", (F.col("length") * (1 - mono)).alias("rank"))
