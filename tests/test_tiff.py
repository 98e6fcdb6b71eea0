"""TIFF rasters: round trips, other layouts made by hand, blocks chosen by bounds, and bad files."""

import struct
import zlib

import numpy as np
import pytest

from cuesta.sources import tiff


def grid(spark, z, g="a"):
    return spark.createDataFrame([(g, r, c, float(v)) for (r, c), v in np.ndenumerate(z)], "grid_id string, r int, c int, z double")


def array(rows, shape):
    out = np.full(shape, -1.0)
    for x in rows:
        out[x.r, x.c] = x.z
    return out


def test_round_trip_over_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = np.round(rng.normal(size=(70, 45)) * 100, 1).astype(np.float32).astype(float)
    z[3:9, 5:12] = np.nan
    made = tiff.write_geotiffs(grid(spark, z), str(tmp_path / "set"), (1000.0, 10.0, 0, 5000.0, 0, -10.0), size=32).collect()
    assert {(m.file, m.rows, m.columns) for m in made} == {(f"a_{i}_{j}.tif", min(32, 70 - 32 * i), min(32, 45 - 32 * j)) for i in range(3) for j in range(2)}
    for i in range(3):
        for j in range(2):
            at = f"{tmp_path}/set/a_{i}_{j}.tif"
            part = z[32 * i : 32 * i + 32, 32 * j : 32 * j + 32]
            got = array(tiff.read_geotiff(spark, at).collect(), part.shape)
            assert np.array_equal(got, part, equal_nan=True)
            assert tiff.header(at).transform() == pytest.approx((1000 + 320 * j, 10, 0, 5000 - 320 * i, 0, -10))
    assert tiff.read_geotiff(spark, f"file://{tmp_path}/set").count() == z.size
    assert tiff.read_geotiff(spark, str(tmp_path / "set")).where("grid_id = 'a_2_1'").count() == 6 * 13


def build(fields, blocks, order="<", big=False):
    """A file by hand: fields (tag, kind, values) without offsets and sizes, and the blocks' bytes."""
    where, sizes = (324, 325) if any(t == 322 for t, *_ in fields) else (273, 279)
    at, offsets = 16, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    fields = sorted([*fields, (where, 16 if big else 4, offsets), (sizes, 16 if big else 4, [len(b) for b in blocks])])
    one, form = (20, "Q") if big else (12, "I")
    extra_at = at + (8 if big else 2) + one * len(fields) + (8 if big else 4)
    entries, extra = b"", b""
    for tag, kind, values in fields:
        data = struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[kind] * len(values), *values)
        own = struct.calcsize(form)
        if len(data) > own:
            place, extra = struct.pack(order + form, extra_at + len(extra)), extra + data
        else:
            place = data.ljust(own, b"\0")
        entries += struct.pack(order + "HH" + form, tag, kind, len(values)) + place
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at).ljust(14, b"\0"))
    return head + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + bytes(8 if big else 4) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_with_the_horizontal_predictor(spark, tmp_path, order):
    z = np.random.default_rng(2).integers(0, 60000, (40, 50)).astype(np.uint16)
    wide = np.zeros((48, 64), np.uint16)
    wide[:40, :50] = z
    blocks = []
    for r in range(0, 48, 16):
        for c in range(0, 64, 32):
            t = wide[r : r + 16, c : c + 32]
            d = np.concatenate([t[:, :1], np.diff(t, axis=1)], axis=1).astype(order + "u2")
            blocks.append(zlib.compress(d.tobytes()))
    fields = [(256, 4, [50]), (257, 4, [40]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 4, [32]), (323, 4, [16]), (339, 3, [1])]
    (tmp_path / "t.tif").write_bytes(build(fields, blocks, order))
    assert np.array_equal(array(tiff.read_geotiff(spark, str(tmp_path)).collect(), z.shape), z)


def test_bands_apart_and_together_and_the_floating_predictor(spark, tmp_path):
    z = np.random.default_rng(3).normal(size=(9, 7, 2)).astype(np.float32)
    shared = [(256, 4, [7]), (257, 4, [9]), (258, 3, [32, 32]), (277, 3, [2]), (278, 4, [4]), (339, 3, [3, 3])]
    cuts = [slice(0, 4), slice(4, 8), slice(8, 9)]
    (tmp_path / "together.tif").write_bytes(build([*shared, (259, 3, [1])], [z[s].astype("<f4").tobytes() for s in cuts], big=True))

    def differences(part):
        bytes_ = np.moveaxis(np.ascontiguousarray(part, ">f4").view(np.uint8).reshape(*part.shape, 4), 2, 1).reshape(len(part), -1)
        return np.concatenate([bytes_[:, :1], np.diff(bytes_, axis=1)], axis=1).astype(np.uint8)

    apart = [zlib.compress(differences(z[s, :, k]).tobytes()) for k in range(2) for s in cuts]
    (tmp_path / "apart.tif").write_bytes(build([*shared, (259, 3, [8]), (284, 3, [2]), (317, 3, [3])], apart))
    rows = tiff.read_geotiff(spark, str(tmp_path), block_bytes=100).collect()
    for name in ("together", "apart"):
        for k in (1, 2):
            got = array([x for x in rows if x.grid_id == name and x.band == k], (9, 7))
            assert np.array_equal(got.astype(np.float32), z[:, :, k - 1])


def test_bounds_choose_blocks(tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encoded(np.zeros((640, 10), np.float32), (0, 1, 0, 0, 0, -1), -9999.0))
    reader = tiff._Reader({"path": str(tmp_path), "block_bytes": "1"})
    assert len(reader.partitions()) == 10
    kept = list(reader.pushFilters([tiff.GreaterThanOrEqual(("r",), 130), tiff.LessThan(("r",), 256), tiff.EqualTo(("c",), 3)]))
    assert len(kept) == 3 and [p.value[1] for p in reader.partitions()] == [[2], [3], [4]]
    none = tiff._Reader({"path": str(tmp_path)})
    list(none.pushFilters([tiff.EqualTo(("grid_id",), "b")]))
    assert [p.value for p in none.partitions()] == [None]


def test_bad_files(tmp_path):
    (tmp_path / "no.tif").write_bytes(b"not a picture at all")
    with pytest.raises(ValueError, match="no.tif"):
        tiff.header(str(tmp_path / "no.tif"))
    (tmp_path / "lzw.tif").write_bytes(build([(256, 4, [1]), (257, 4, [1]), (258, 3, [8]), (259, 3, [5])], [b"x"]))
    with pytest.raises(ValueError, match="unsupported"):
        tiff.header(str(tmp_path / "lzw.tif"))
    with pytest.raises(FileNotFoundError):
        tiff.header(str(tmp_path / "absent.tif"))
