"""Column expressions over catalogue items: times, months, cloud, asset addresses and map zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesta.functions.numeric import Name, col


def _expanded(v: Column, end: str) -> Column:
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit(end))).otherwise(v)


def normalize_datetime(value: Name) -> Column:
    """An RFC 3339 interval or instant: a bare date is its whole day, open ends ('..' or empty) stay."""
    v = F.trim(col(value))
    parts = F.split(v, "/")
    first, last = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    both = F.concat(_expanded(first, "T00:00:00Z"), F.lit("/"), _expanded(last, "T23:59:59Z"))
    day = F.concat(v, F.lit("T00:00:00Z/"), v, F.lit("T23:59:59Z"))
    return F.when(F.contains(v, F.lit("/")), both).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(v)


def item_month(datetime: Name) -> Column:
    return F.substring(col(datetime), 6, 2).cast("int")


def cloud_cover(cloud: Name) -> Column:
    """Missing cloud cover counts as 100."""
    return F.coalesce(col(cloud).cast("double"), F.lit(100.0))


def asset_href(assets: Name, key: str, prefer_s3: bool = False) -> Column:
    """The address of an asset in a map of structs (href, s3_href); an error lists what there is."""
    asset = F.try_element_at(col(assets), F.lit(key))
    href = F.coalesce(asset["s3_href"], asset["href"]) if prefer_s3 else asset["href"]
    missing = F.raise_error(F.concat(F.lit(f"no asset {key!r}; available: "), F.array_join(F.array_sort(F.map_keys(col(assets))), ", ")))
    return F.when(asset.isNull(), missing.cast("string")).otherwise(href)


def to_vsicurl(href: Name) -> Column:
    """The virtual-file address of a remote object; local and virtual ones stay."""
    h = col(href)
    return F.when(h.startswith("s3://"), F.concat(F.lit("/vsis3/"), F.substr(h, F.lit(6)))).when(h.startswith("http://") | h.startswith("https://"), F.concat(F.lit("/vsicurl/"), h)).otherwise(h)


def utm_epsg(west: Name, south: Name, east: Name, north: Name) -> Column:
    """EPSG code of the UTM zone of a box's centre."""
    lon, lat = (col(west) + col(east)) / 2, (col(south) + col(north)) / 2
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def oversized(west: Name, south: Name, east: Name, north: Name, most: float = 0.5) -> Column:
    """Whether a box of interest is larger than a request may be."""
    return F.greatest(col(east) - col(west), col(north) - col(south)) > most


def group_name(west: Name, south: Name, east: Name, north: Name) -> Column:
    """A label of the box's centre, e.g. 27.750N 82.450E."""
    lon, lat = (col(west) + col(east)) / 2, (col(south) + col(north)) / 2
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.concat(F.format_string("%.3f", F.abs(lat)), ns, F.lit(" "), F.format_string("%.3f", F.abs(lon)), ew)
