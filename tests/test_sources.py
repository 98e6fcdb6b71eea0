"""Catalogue search with a stand-in opener, trace files, and written grids."""

import io
import json

import pytest

from cuesta.sources import catalogue, rasters, traces

ASKED = []


def opener(request, timeout=None):
    """Two pages of items, then no more; the second is asked for by the body of the link."""
    body = json.loads(request.data)
    ASKED.append(body)
    first = "page" not in body
    item = {"id": "a" if first else "b", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2023-07-15T00:00:00Z", "eo:cloud_cover": 3 if first else 40}, "assets": {"red": {"href": "s3://x/red.tif"}}}
    links = [{"rel": "next", "method": "POST", "href": request.full_url, "body": body | {"page": 2}}] if first else [{"rel": "next", "href": "http://other", "method": "GET"}]
    return io.BytesIO(json.dumps({"features": [item], "links": links}).encode())


def test_pages_are_followed_and_cut(monkeypatch):
    ASKED.clear()
    found = list(catalogue.search_items("http://c/", "one", [0, 0, 1, 1], "2023-07-01/2023-07-31", opener=opener))
    assert [x["id"] for x in found] == ["a", "b"]
    assert ASKED[0]["collections"] == ["one"] and ASKED[0]["datetime"] == "2023-07-01T00:00:00Z/2023-07-31T23:59:59Z"
    assert len(list(catalogue.search_items("http://c", ["one"], [0, 0, 1, 1], max_items=1, opener=opener))) == 1


def test_failures_are_named():
    def broken(request, timeout=None):
        raise OSError("no route")

    with pytest.raises(catalogue.CatalogueError, match="no route"):
        catalogue.post_json("http://c/search", {}, opener=broken)
    with pytest.raises(catalogue.CatalogueError):
        catalogue.post_json("http://c/search", {}, opener=lambda r, timeout: io.BytesIO(b"no json"))


@pytest.mark.parametrize(("value", "full"), [("2023-01-02", "2023-01-02T00:00:00Z/2023-01-02T23:59:59Z"), ("2023-01-02/..", "2023-01-02T00:00:00Z/.."), ("2023-01-02T05:00:00Z", "2023-01-02T05:00:00Z")])
def test_whole_days(value, full):
    assert catalogue.whole_days(value) == full


def test_items_as_a_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.sparkContext.addPyFile(__file__)  # workers import the opener by name
    spark.dataSource.register(catalogue.ItemSource)
    items = spark.read.format("items").option("url", "http://c").option("collections", "one").option("bbox", "0,0,1,1;2,2,3,3").option("opener", f"{__name__}:opener").load()
    rows = items.where("cloud < 50").orderBy("ord").collect()
    assert [r.id for r in rows] == ["a", "b", "a", "b"] and rows[0].assets["red"].href == "s3://x/red.tif"


def test_interlis(spark, tmp_path):
    f = tmp_path / "x.itf"
    f.write_text("SCNT\nTABL t\nOBJE 0 @\nSTPT 1 2\nLIPT 3 4\nELIN\nOBJE 1 @\nSTPT 5 6\nLIPT 7 8\nLIPT 9 10\nELIN\n")
    rows = [(r.trace_id, r.seq, r.x, r.y) for r in traces.read_interlis(spark, str(f)).orderBy("trace_id", "seq").collect()]
    assert rows == [(0, 0, 1, 2), (0, 1, 3, 4), (1, 0, 5, 6), (1, 1, 7, 8), (1, 2, 9, 10)]


def test_geojson(spark, tmp_path):
    f = tmp_path / "x.json"
    shapes = [{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "MultiLineString", "coordinates": [[[2, 2], [3, 3]], [[9, 9]]]}]
    f.write_text(json.dumps({"features": [{"properties": {"class": "contact"}, "geometry": g} for g in shapes]}))
    rows = traces.read_geojson(spark, str(f)).orderBy("feature", "seq").collect()
    assert [(r.feature, r.part, r.x) for r in rows] == [(0, 0, 0), (0, 0, 1), (1, 0, 2), (1, 0, 3)]


def test_grids_are_read_as_written(spark, tmp_path):
    rows = [("g0", 0, 0, 1.5, 2.0), ("g0", 0, 1, float("nan"), 3.0)]
    p = spark.createDataFrame(rows, "grid_id string, r int, c int, z double, w double")
    rasters.write_grid(p, str(tmp_path / "g"), ["z", "w"])
    back = {(r.r, r.c): r for r in rasters.read_grid(spark, str(tmp_path / "g"), ["z", "w"]).collect()}
    assert back[0, 0].z == 1.5 and back[0, 1].z != back[0, 1].z and back[0, 1].w == 3


def test_a_failed_optional_layer_is_reported(spark, tmp_path):
    def fails():
        raise OSError("out of reach")

    done = rasters.write_layers({"a": spark.range(3)}, str(tmp_path), {"imagery": fails})
    assert spark.read.parquet(done["a"]).count() == 3 and "out of reach" in done["imagery"]
