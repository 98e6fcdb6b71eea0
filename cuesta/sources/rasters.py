"""Grids in tables: laying tiles together, clipping, alignment to another grid, and writing with a nodata value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesta.functions.grid import Transform, pixels_to_world, world_cell
from cuesta.functions.numeric import finite, nan
from cuesta.functions.projection import from_utm
from cuesta.operators.normalise import gdal_cells, read_cells
from cuesta.operators.polyline import sample_bilinear

NODATA = -9999.0


def mosaic(pixels: DataFrame) -> DataFrame:
    """pixels(source, grid_id, r, c, x, y, z) on one lattice, one row a pixel: the last source with a value wins."""
    z = F.max_by("z", F.when(finite("z"), F.col("source")))
    out = pixels.groupBy("grid_id", "r", "c").agg(F.first("x").alias("x"), F.first("y").alias("y"), z.alias("z"))
    return out.withColumn("z", F.coalesce("z", nan()))


def clipped(pixels: DataFrame, box: Sequence[float]) -> DataFrame:
    """Pixels whose centre (x, y) lies in the box."""
    return pixels.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def lattice(spark: SparkSession, height: int, width: int, grid_id: str = "g0") -> DataFrame:
    """(grid_id, r, c) of a whole grid, made in parallel by rows."""
    rows = spark.range(height).select(F.lit(grid_id).alias("grid_id"), F.col("id").cast("int").alias("r"))
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def aligned(source: DataFrame, source_gt: Transform, target: DataFrame, target_gt: Transform, nearest: bool = False) -> DataFrame:
    """target(grid_id, r, c) with z of a source grid in the same coordinates: bilinear at the pixel centres, or the
    pixel that holds them (for categories).  NaN outside."""
    x, y = pixels_to_world("r", "c", target_gt)
    at = target.select("grid_id", "r", "c", x.alias("x"), y.alias("y"))
    if not nearest:
        moved = at.select(F.col("grid_id").alias("_g"), F.col("r").alias("_tr"), F.col("c").alias("_tc"), "x", "y")
        return sample_bilinear(moved, source, source_gt).select(F.col("_g").alias("grid_id"), F.col("_tr").alias("r"), F.col("_tc").alias("c"), "z")
    r, c = world_cell("x", "y", source_gt)
    values = source.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "z")
    return at.withColumn("_r", r).withColumn("_c", c).join(values, ["_r", "_c"], "left").select("grid_id", "r", "c", F.coalesce("z", nan()).alias("z"))


def warped(source: DataFrame, source_gt: Transform, target: DataFrame, target_gt: Transform, zone: int, north: bool = True) -> DataFrame:
    """target(grid_id, r, c), a grid in UTM metres of a zone, with z of a source grid in degrees (x is the longitude),
    bilinear at the target's pixel centres; NaN outside."""
    x, y = pixels_to_world("r", "c", target_gt)
    at = target.select(F.col("grid_id").alias("_g"), F.col("r").alias("_tr"), F.col("c").alias("_tc"), x.alias("_e"), y.alias("_n"), F.lit(zone).alias("_z"), F.lit(north).alias("_north"))
    placed = from_utm(at, "_e", "_n", "_z", "_north").withColumnsRenamed({"lon": "x", "lat": "y"})
    return sample_bilinear(placed, source, source_gt).select(F.col("_g").alias("grid_id"), F.col("_tr").alias("r"), F.col("_tc").alias("c"), "z")


def write_grid(pixels: DataFrame, path: str, bands: Sequence[str], nodata: float = NODATA, mode: str = "error") -> None:
    """Bands in long form under path/grid_id=.../band=..., as floats with nodata for what is not finite."""
    long = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), gdal_cells(b, nodata).alias("value")) for b in bands))).alias("_v")
    rows = pixels.select("grid_id", "r", "c", long).select("grid_id", "r", "c", "_v.*")
    rows.repartition("grid_id", "band").write.mode(mode).partitionBy("grid_id", "band").parquet(path)


def read_grid(spark: SparkSession, path: str, bands: Sequence[str], nodata: float | None = NODATA) -> DataFrame:
    """(grid_id, r, c, a column for each band) of what write_grid wrote; only the folders of those bands are read."""
    rows = spark.read.parquet(path).where(F.col("band").isin(*bands)).withColumn("z", read_cells("value", nodata))
    return rows.groupBy(F.col("grid_id").cast("string").alias("grid_id"), "r", "c").agg(*(F.max(F.when(F.col("band") == b, F.col("z"))).alias(b) for b in bands))


def write_layers(layers: Mapping[str, DataFrame], path: str, optional: Mapping[str, object] | None = None, mode: str = "error") -> dict[str, str]:
    """Each layer as a table under path; the optional ones are functions, and one that fails is left out.

    Gives what happened to each: its path, or the error.
    """
    done = {}
    for name, frame in layers.items():
        frame.write.mode(mode).parquet(f"{path}/{name}")
        done[name] = f"{path}/{name}"
    for name, make in (optional or {}).items():
        try:
            make().write.mode(mode).parquet(f"{path}/{name}")
            done[name] = f"{path}/{name}"
        except Exception as e:  # imagery may be out of reach; the surface's layers stand without it
            done[name] = f"failed: {e}"
    return done


def aggregate_terrain(pixels: DataFrame, px: float, path: str, bands: Sequence[str], optional: Mapping[str, object] | None = None, mode: str = "error") -> dict[str, str]:
    """The derived layers of a surface, written: elevation, terrain bands, contact strength with its edges, and optional imagery."""
    from cuesta.operators.stencils import terrain_stack
    from cuesta.operators.tracing import contact_strength

    strength = contact_strength(pixels, px)
    layers = {"elevation": pixels.select("grid_id", "r", "c", "z"), "terrain": terrain_stack(pixels, px, bands), "contact_strength": strength.drop("rail"), "edges": strength.where("rail").select("grid_id", "r", "c")}
    return write_layers(layers, path, optional, mode)
