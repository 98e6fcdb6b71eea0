"""Shapefiles made by hand: parts, nulls, heights, attributes, ranges of the index, and bad records."""

import struct

import pytest

from cuesta.sources import shapes


def line(parts, kind=3):
    points = [p for part in parts for p in part]
    first, at = [], 0
    for part in parts:
        first.append(at)
        at += len(part)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    out = struct.pack("<i4dii", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(first)}i", *first)
    out += b"".join(struct.pack("<2d", *p) for p in points)
    return out + (struct.pack(f"<{2 + len(points)}d", 0, 0, *[7.0] * len(points)) if kind == 13 else b"")


def write(path, records, rows=None):
    body, index, at = b"", b"", 100
    for k, r in enumerate(records):
        body += struct.pack(">ii", k + 1, len(r) // 2) + r
        index += struct.pack(">ii", at // 2, len(r) // 2)
        at += 8 + len(r)
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, at // 2) + struct.pack("<ii8d", 1000, 3, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head + body)
    path.with_suffix(".shx").write_bytes(head + index)
    if rows is not None:
        field = b"class".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15)
        path.with_suffix(".dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, len(rows), 65, 11).ljust(32, b"\0") + field + b"\r" + b"".join(b" " + r.encode().ljust(10) for r in rows))


ONE, TWO = [(0.0, 0.0), (1.0, 2.0), (3.0, 2.0)], [(5.0, 5.0), (6.0, 6.0)]


def test_parts_nulls_heights_and_attributes(spark, tmp_path):
    records = [line([ONE, TWO]), struct.pack("<i", 0), line([TWO], 13), struct.pack("<i2d", 1, 4.0, 4.0), line([[(9.0, 9.0)], ONE])]
    write(tmp_path / "a", records, ["drainage", "x", "", "y"])  # the table is a row short
    for n in (1, 2, 100):
        rows = shapes.read_shapefile(spark, str(tmp_path), records=n).orderBy("feature", "part", "seq").collect()
        got = {}
        for r in rows:
            got.setdefault((r.feature, r.part, r["class"]), []).append((r.x, r.y))
            assert r.trace_id == f"{r.file}/{r.feature}/{r.part}"
        assert got == {(0, 0, "drainage"): ONE, (0, 1, "drainage"): TWO, (2, 0, None): TWO, (4, 1, None): ONE}


def test_without_a_table_and_without_records(spark, tmp_path):
    write(tmp_path / "b", [line([TWO])])
    assert {r["class"] for r in shapes.read_shapefile(spark, f"file://{tmp_path}/b.shp").collect()} == {None}
    write(tmp_path / "none", [], [])
    assert shapes.read_shapefile(spark, str(tmp_path / "none.shp")).collect() == []
    with pytest.raises(FileNotFoundError):
        shapes._files(str(tmp_path / "absent.shp"))


def test_bad_records(spark, tmp_path):
    bad = bytearray(line([ONE]))
    bad[40:44] = struct.pack("<i", 1000)
    write(tmp_path / "c", [line([TWO]), bytes(bad)])
    with pytest.raises(Exception, match="record 1: counts do not fit"):
        shapes.read_shapefile(spark, str(tmp_path / "c.shp")).collect()
    assert shapes.read_shapefile(spark, str(tmp_path / "c.shp"), skip_bad=True).count() == 2
    with pytest.raises(ValueError, match="too short"):
        shapes.parts(b"")
