"""Band ratios of reflectances; NaN where a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column

from cuesta.functions.numeric import Name, col, ratio


def normalized_ratio(a: Name, b: Name) -> Column:
    return ratio(col(a) - col(b), col(a) + col(b))


def ndvi(nir: Name, red: Name) -> Column:
    return normalized_ratio(nir, red)


def ndmi(nir: Name, swir16: Name) -> Column:
    return normalized_ratio(nir, swir16)


def clay_index(swir16: Name, swir22: Name) -> Column:
    return ratio(swir16, swir22)


def iron_oxide_index(red: Name, blue: Name) -> Column:
    return ratio(red, blue)


def ferrous_index(swir16: Name, nir: Name) -> Column:
    return ratio(swir16, nir)


#: Spectral bands by name: the input bands and the expression.  The last two are stretched by the stack builder.
SPECTRAL_BANDS = {
    "ndvi": (("nir", "red"), ndvi),
    "clay": (("swir16", "swir22"), clay_index),
    "iron_oxide": (("red", "blue"), iron_oxide_index),
    "ferrous": (("swir16", "nir"), ferrous_index),
    "swir22_s": (("swir22",), col),
    "swir16_s": (("swir16",), col),
}
STRETCHED = ("swir22_s", "swir16_s")
