"""Stretching and stacking of bands.  Percentiles of a grid are exact and interpolate linearly; they come from range
partitions of its values (see ``order``) and are joined back, one row for each grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesta.functions.numeric import nan, clip, finite, known
from cuesta.functions.spectral import SPECTRAL_BANDS, STRETCHED
from cuesta.operators.fixpoint import settled
from cuesta.operators.order import quantiles

KEYS = ["grid_id", "r", "c"]


def limits(pixels: DataFrame, value: Column, lo: float, hi: float) -> DataFrame:
    """(grid_id, lo, hi): percentiles of the finite values of each grid that has any."""
    return quantiles(pixels.select("grid_id", value.alias("v")), {"_lo": lo / 100, "_hi": hi / 100})


def percentile_stretch(pixels: DataFrame, band: str, lo: float = 2, hi: float = 98, name: str | None = None) -> DataFrame:
    """pixels with the band scaled to [0, 1] between two percentiles; a constant band gives 0, NaN stays, an empty one is unchanged."""
    z = F.col(band)
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, clip((z - F.col("_lo")) / F.when(span > 0, span), 0, 1)).otherwise(F.lit(0.0))
    out = F.when(F.col("_lo").isNull(), z).when(finite(z), scaled).otherwise(nan())
    return pixels.join(limits(pixels, known(band), lo, hi), "grid_id", "left").withColumn(name or band, out).drop("_lo", "_hi")


def normalize01(pixels: DataFrame, band: str, name: str | None = None) -> DataFrame:
    return percentile_stretch(pixels, band, name=name)


def cost_norm(pixels: DataFrame, band: str, valid: Column, name: str, lo: float = 2, hi: float = 98) -> DataFrame:
    """The cost surface's variant: NaN counts as 0, percentiles are over valid cells, and the divisor is 1e-6 at least."""
    z = F.when(finite(band), F.col(band)).otherwise(0.0)
    joined = pixels.join(limits(pixels, F.when(valid, z), lo, hi), "grid_id", "left")
    out = clip((z - F.coalesce("_lo", F.lit(0.0))) / F.greatest(F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1e-6)), 0, 1)
    return joined.withColumn(name, out).drop("_lo", "_hi")


def stretch_u8(pixels: DataFrame, band: str, lo: float = 2, hi: float = 98, name: str | None = None) -> DataFrame:
    """pixels with the band as a byte, truncated (within 1e-9 of a step counts as that step); NaN gives 0."""
    z = F.col(band)
    top = F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi"))
    byte = F.floor(clip((z - F.col("_lo")) / (top - F.col("_lo")), 0, 1) * 255 + 1e-9)
    out = F.when(finite(z) & F.col("_lo").isNotNull(), byte).otherwise(0).cast("smallint")
    return pixels.join(limits(pixels, known(band), lo, hi), "grid_id", "left").withColumn(name or band, out).drop("_lo", "_hi")


def spectral_stack(pixels: DataFrame, names: Sequence[str], bands: Mapping[str, str] | None = None) -> DataFrame:
    """(grid_id, r, c, named spectral bands) from reflectance columns; bands maps band names to columns."""
    bands = dict(bands or {c: c for c in pixels.columns})
    for n in names:
        if n not in SPECTRAL_BANDS:
            raise KeyError(f"unknown spectral band: {n}")
        for b in SPECTRAL_BANDS[n][0]:
            if b not in bands:
                raise KeyError(f"{n} needs the band {b}")
    out = settled(pixels.select(*KEYS, *(SPECTRAL_BANDS[n][1](*(bands[b] for b in SPECTRAL_BANDS[n][0])).alias(n) for n in names)))
    for n in names:
        if n in STRETCHED:
            out = percentile_stretch(out, n)
    return out.select(*KEYS, *names)


def assemble(layers: Mapping[str, DataFrame], normalize: bool = True) -> DataFrame:
    """One row per pixel with a column per layer (each layer: grid_id, r, c, z); NaN in one is NaN in all."""
    if not layers:
        raise ValueError("no layers to assemble")
    parts = [(percentile_stretch(df, "z") if normalize else df).select(*KEYS, F.col("z").alias(name)) for name, df in layers.items()]
    joined = reduce(lambda a, b: a.join(b, KEYS, "full"), parts)
    whole = reduce(lambda a, b: a & b, [finite(n) for n in layers])
    torn = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in layers])
    error = F.raise_error("the layers do not cover the same pixels").cast("double")
    return joined.select(*KEYS, *(F.when(torn, error).when(whole, F.col(n)).otherwise(nan()).alias(n) for n in layers))


def weighted_response(pixels: DataFrame, bands: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """(grid_id, r, c, response): weighted mean of stretched bands, NaN where any is."""
    weights = [1.0] * len(bands) if weights is None else list(weights)
    if len(weights) != len(bands):
        raise ValueError("one weight for each band is needed")
    out = settled(pixels.select(*KEYS, *bands))
    for b in bands:
        out = percentile_stretch(out, b)
    whole = reduce(lambda a, b: a & b, [finite(b) for b in bands])
    total = reduce(lambda a, b: a + b, [F.col(b) * float(w) for b, w in zip(bands, weights, strict=True)])
    return out.select(*KEYS, F.when(whole, total / float(sum(weights))).otherwise(nan()).alias("response"))


def nan_mean(columns: Sequence[str]) -> Column:
    """Mean of the finite columns of a row; NaN if there is none."""
    n = reduce(lambda a, b: a + b, [finite(c).cast("int") for c in columns])
    total = reduce(lambda a, b: a + b, [F.when(finite(c), F.col(c)).otherwise(0.0) for c in columns])
    return F.when(n > 0, total / F.when(n > 0, n)).otherwise(nan())


def gdal_cells(band: str, nodata: float = -9999.0) -> Column:
    """The value as it is written to a raster file: float, non-finite cells as nodata."""
    return F.when(finite(band), F.col(band).cast("float")).otherwise(F.lit(nodata).cast("float"))


def read_cells(band: str, nodata: float | None) -> Column:
    """A stored value as a grid cell: nodata becomes NaN."""
    value = F.col(band).cast("double")
    return value if nodata is None else F.when(value == nodata, nan()).otherwise(value)
