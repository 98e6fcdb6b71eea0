"""Item catalogues behind a search API: paging, a Spark data source with filters pushed into the request, and scene loading.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ItemSource)
    spark.read.format("items").option("url", ...).option("collections", "a,b").option("bbox", "0,0,1,1").load()
"""

from __future__ import annotations

import importlib
import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, LessThan, LessThanOrEqual

from cuesta.functions.catalogue import asset_href
from cuesta.operators import scenes

#: Collections and the names that bands have in the catalogue.
ELEVATION = "cop-dem-glo-30"
IMAGERY = "sentinel-2-l2a"
BANDS = ("coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3", "nir", "nir08", "nir09", "swir16", "swir22", "scl")
CLOUD_START, CLOUD_CEILING = 5.0, 20.0

SCHEMA = "ord long, id string, datetime string, cloud double, bbox array<double>, assets map<string, struct<href: string, s3_href: string>>"


class CatalogueError(RuntimeError):
    """A request that failed, or an answer that is no JSON, or nothing found."""


def post_json(url: str, body: dict, timeout: float = 60, opener: Callable | None = None) -> dict:
    """The JSON answer to a JSON body."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json"}, method="POST")
    try:
        with (opener or urllib.request.urlopen)(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError) as e:
        raise CatalogueError(f"{url}: {e}") from e


def next_page(page: dict, url: str) -> tuple[str, dict] | None:
    """Address and body of the next page; a link that is not a POST has no body and ends the search."""
    link = next((x for x in page.get("links", ()) if x.get("rel") == "next"), None)
    if link is None or (link.get("method") or "POST").upper() != "POST" or link.get("body") is None:
        return None
    return link.get("href", url), link["body"]


def whole_days(value: str) -> str:
    """An interval of full instants: bare dates become the start, or the end, of their day; open ends stay."""
    first, slash, last = value.partition("/")
    if not slash and "T" in value:
        return value

    def full(x: str, time: str) -> str:
        x = x.strip()
        return x if x in ("", "..") or "T" in x else x + time

    return f"{full(first, 'T00:00:00Z')}/{full(last if slash else first, 'T23:59:59Z')}"


def search_items(url: str, collections: str | Sequence[str], bbox: Sequence[float], datetime: str | None = None, query: dict | None = None, limit: int = 100, max_items: int = 1000, opener: Callable | None = None) -> Iterator[dict]:
    """Items page by page, ``max_items`` at most."""
    body = {"collections": [collections] if isinstance(collections, str) else list(collections), "bbox": list(bbox), "limit": limit}
    body |= ({"datetime": whole_days(datetime)} if datetime else {}) | ({"query": query} if query else {})
    page: tuple[str, dict] | None = (url.rstrip("/") + "/search", body)
    left = max_items
    while page and left > 0:
        answer = post_json(*page, opener=opener)
        for item in answer.get("features", ())[:left]:
            left -= 1
            yield item
        page = next_page(answer, page[0])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.query = json.loads(options.get("query", "{}"))

    def pushFilters(self, filters):
        """Upper bounds of cloud go into the request; Spark applies them again, since catalogues may ignore them."""
        names = {LessThan: "lt", LessThanOrEqual: "lte"}
        for f in filters:
            if type(f) in names and f.attribute == ("cloud",):
                self.query.setdefault("eo:cloud_cover", {})[names[type(f)]] = f.value
            yield f

    def partitions(self):
        """One for each bounding box (boxes are split by ';'): a chain of pages is read in order."""
        return [InputPartition((n, box)) for n, box in enumerate(self.options["bbox"].split(";"))]

    def read(self, partition):
        n, box = partition.value
        opener = None
        if "opener" in self.options:  # module:function, for tests and for signed requests
            module, name = self.options["opener"].split(":")
            opener = getattr(importlib.import_module(module), name)
        o = self.options
        found = search_items(o["url"], o["collections"].split(","), [float(x) for x in box.split(",")], o.get("datetime"), self.query or None, int(o.get("limit", 100)), int(o.get("max_items", 1000)), opener)
        for k, item in enumerate(found):
            about = item.get("properties", {})
            cloud = about.get("eo:cloud_cover")
            assets = {a: (x.get("href"), x.get("alternate", {}).get("s3", {}).get("href")) for a, x in item.get("assets", {}).items()}
            yield (n << 32 | k, item["id"], about.get("datetime"), None if cloud is None else float(cloud), [float(x) for x in item["bbox"]] if item.get("bbox") else None, assets)


class ItemSource(DataSource):
    """Items of a catalogue; options url, collections, bbox, datetime, query, limit, max_items, opener."""

    @classmethod
    def name(cls):
        return "items"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def overlapping(items: DataFrame, box: Sequence[float], first: str | None = None, last: str | None = None, cloud: float | None = None, max_items: int | None = None) -> DataFrame:
    """The same search over a table of items(ord, datetime, cloud, bbox): boxes that meet, times within, cloud below."""
    b = F.col("bbox")
    out = items.where((b[0] <= box[2]) & (b[2] >= box[0]) & (b[1] <= box[3]) & (b[3] >= box[1]))
    out = out if first is None else out.where(F.col("datetime") >= first)
    out = out if last is None else out.where(F.col("datetime") <= last)
    out = out if cloud is None else out.where(F.col("cloud") < cloud)
    return out if max_items is None else out.orderBy("ord").limit(max_items)


Loader = Callable[[SparkSession, list[str]], DataFrame]


def fetch_elevation(items: DataFrame, box: Sequence[float], load: Loader, key: str = "data") -> DataFrame:
    """The elevation grid of a box: ``load`` gives the pixels (source, grid_id, r, c, x, y, z) of addresses; all tiles that meet it are laid together."""
    from cuesta.sources.rasters import clipped, mosaic

    found = [r.href for r in overlapping(items, box).orderBy("ord").select(asset_href("assets", key).alias("href")).collect()]  # the tiles of one box
    if not found:
        raise CatalogueError("no elevation tile meets the box")
    return clipped(mosaic(load(items.sparkSession, found)), box)


def fetch_band(items: DataFrame, box: Sequence[float], band: str, load: Loader, months: Sequence[int] | None = None, auto_season: bool = True, first: float = CLOUD_START, ceiling: float = CLOUD_CEILING) -> DataFrame:
    """One scene's band over a box: the given months, else the clearest ones, are preferred; cloud limits rise until a scene is found."""
    from cuesta.sources.rasters import clipped, mosaic

    there = overlapping(items, box).select("*", F.lit(0).alias("aoi"), F.to_date(F.substring("datetime", 1, 10)).alias("d"))
    if months is None:
        months = [r.month for r in scenes.clearest_months(there).orderBy("place").collect()] if auto_season else []
    clear = scenes.clear_scenes(there, first, ceiling).drop("threshold")
    best = scenes.pick_scene(clear, months).select(asset_href("assets", band).alias("href")).collect()
    if not best:
        raise CatalogueError(f"no scene with {ceiling} % of cloud or less")
    return clipped(mosaic(load(items.sparkSession, [best[0].href])), box)
