"""Edges of a response band: gradient, thinning along the gradient, hysteresis; tensor responses; the detector registry.

Grids are long form (grid_id, r, c, value).  Thresholds are quantiles of each
grid's gradient magnitude over its valid cells.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesta.functions.grid import Transform
from cuesta.functions.numeric import col, finite
from cuesta.operators import kernels
from cuesta.operators.fixpoint import settled
from cuesta.operators.normalise import KEYS, limits, weighted_response
from cuesta.operators.regions import components
from cuesta.operators.stencils import nine
from cuesta.operators.tiles import SIZE


def suppressed(gradients: DataFrame) -> DataFrame:
    """gradients(grid_id, r, c, magnitude, gx, gy) with nms: the magnitude where it is no less than one step
    up and down its gradient, else 0.

    The step is a unit vector, so its bilinear sample lies among the cell's eight neighbours.
    """
    p = nine(gradients, "magnitude")
    size = F.col("magnitude") + 1e-12
    x, y = F.col("gx") / size, F.col("gy") / size
    a, b = F.abs(y), F.abs(x)
    z = [None, *(F.col(f"z{k}") for k in range(1, 10))]

    def sample(east: Column, south: Column) -> Column:
        side = F.when(east, z[6]).otherwise(z[4])
        along = F.when(south, z[8]).otherwise(z[2])
        corner = F.when(south, F.when(east, z[9]).otherwise(z[7])).otherwise(F.when(east, z[3]).otherwise(z[1]))
        return (1 - a) * ((1 - b) * z[5] + b * side) + a * ((1 - b) * along + b * corner)

    ahead, back = sample(x > 0, y > 0), sample(x < 0, y < 0)
    keep = (z[5] >= ahead) & (z[5] >= back)
    return p.select(*gradients.columns, F.when(keep, z[5]).otherwise(0.0).alias("nms"))


def hysteresis(cells: DataFrame, low: Column, high: Column, value: str = "nms") -> DataFrame:
    """(grid_id, r, c): 8-connected cells of ``low`` and more that a cell of ``high`` and more belongs to."""
    v = F.col(value)
    weak = cells.where((v >= low) & (v > 0)).select(*KEYS, ((v >= high) & (v > 0)).alias("_strong"))
    weak = settled(weak)
    labelled = settled(components(weak).join(weak, KEYS))
    held = labelled.where("_strong").select("grid_id", "label").distinct()
    return labelled.join(held, ["grid_id", "label"], "left_semi").select(*KEYS)


def canny(pixels: DataFrame, value: str = "z", sigma: float = 1.0, low: float = 0.85, high: float = 0.95, valid: Column | None = None, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c) of the edges; none on a grid that is blank or flat."""
    if not 0 <= low <= high <= 1:
        raise ValueError("the quantiles must satisfy 0 <= low <= high <= 1")
    ok = finite(value) if valid is None else finite(value) & valid
    marked = settled(pixels.select(*KEYS, col(value).alias("z"), ok.alias("_ok")))
    g = kernels.gaussian_gradient(marked, sigma, size=size).join(marked.select(*KEYS, "_ok"), KEYS)
    g = settled(g.select(*KEYS, "gx", "gy", "_ok", F.when(F.col("_ok"), F.hypot("gx", "gy")).otherwise(0.0).alias("magnitude")))
    cuts = limits(g, F.when(F.col("_ok"), F.col("magnitude")), 100 * low, 100 * high)
    thin = suppressed(g).where("_ok").join(cuts, "grid_id")
    return hysteresis(thin, F.col("_lo"), F.col("_hi"))


def tensor_response(tensor: DataFrame, kind: str = "anisotropy") -> Column:
    """A response from l1 and l2: their difference, its share of their sum (coherence), or l1 itself."""
    one, two = F.col("l1"), F.col("l2")
    kinds = {"anisotropy": one - two, "coherence": (one - two) / (one + two + 1e-12), "lambda1": one}
    if kind not in kinds:
        raise ValueError(f"unknown kind of response: {kind}")
    return kinds[kind]


def linear_response(pixels: DataFrame, bands: Sequence[str], sigma: float = 1.0, scale: float = 3.0, kind: str = "anisotropy", weights: Sequence[float] | None = None) -> DataFrame:
    """(grid_id, r, c, response) of the tensor summed over bands; NaN where a band is nodata."""
    tensor = kernels.structure_tensor(pixels, list(bands), sigma, scale, weights)
    return tensor.select(*KEYS, tensor_response(tensor, kind).alias("response"))


# Detectors

Detector = Callable[..., DataFrame]
_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> Detector:
    """Make a detector (pixels, bands, **options) -> polylines known by name."""
    if not name:
        raise ValueError("a detector needs a name")
    if name in _DETECTORS:
        raise ValueError(f"a detector named {name} exists")
    _DETECTORS[name] = detector
    return detector


def get_detector(name: str) -> Detector:
    return _DETECTORS[name]


def available_detectors() -> list[str]:
    return sorted(_DETECTORS)


def classical(pixels: DataFrame, bands: Sequence[str], weights: Sequence[float] | None = None, sigma: float = 1.0, low: float = 0.85, high: float = 0.95, min_length: int = 5, tolerance: float = 1.0, gt: Transform | None = None) -> DataFrame:
    """(grid_id, trace_id, seq, x, y): polylines of the edges of the bands' weighted, stretched mean."""
    from cuesta.operators.tracing import polylines_from_mask

    mean = weighted_response(pixels, bands, weights)
    edges = canny(mean, "response", sigma, low, high)
    return polylines_from_mask(edges, min_length, tolerance, gt)


register_detector("classical", classical)


def detected(name: str, pixels: DataFrame, bands: Sequence[str], **options: Mapping) -> DataFrame:
    """The polylines of a registered detector."""
    return get_detector(name)(pixels, bands, **options)


def composite(pixels: DataFrame, red: str = "red", green: str = "green", blue: str = "blue") -> DataFrame:
    """(grid_id, r, c, red, green, blue): each band as a byte between its 2nd and 98th percentiles."""
    from cuesta.operators.normalise import stretch_u8

    out = pixels.select(*KEYS, F.col(red).alias("red"), F.col(green).alias("green"), F.col(blue).alias("blue"))
    for band in ("red", "green", "blue"):
        out = stretch_u8(out, band)
    return out.select(*KEYS, "red", "green", "blue")
