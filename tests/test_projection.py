"""UTM against published control points, the meridian's arc by quadrature, and round trips."""

import numpy as np
import pytest

from cuesta.functions import projection


def test_control_points(spark):
    # Published: the CN Tower, the crossing of equator and prime meridian, and a quarter of the meridian at 45 degrees.
    rows = [("tower", -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600), ("origin", 0.0, 0.0), ("axis", 9.0, 45.0), ("south", 9.0, -45.0)]
    got = {r.name: r for r in projection.to_utm(spark.createDataFrame(rows, "name string, lon double, lat double")).collect()}
    assert got["tower"].zone == 17 and got["tower"].easting == pytest.approx(630084, abs=1) and got["tower"].northing == pytest.approx(4833438, abs=1)
    assert got["origin"].zone == 31 and got["origin"].easting == pytest.approx(166021.443, abs=1e-3) and got["origin"].northing == pytest.approx(0, abs=1e-6)
    a, e2 = projection.SEMI_MAJOR, projection.ECCENTRICITY**2
    x, w = np.polynomial.legendre.leggauss(60)
    phi = np.pi / 8 * (x + 1)
    arc = (w * a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum() * np.pi / 8
    assert got["axis"].easting == pytest.approx(500000, abs=1e-6) and got["axis"].northing == pytest.approx(0.9996 * arc, abs=1e-6)
    assert got["south"].northing == pytest.approx(1e7 - 0.9996 * arc, abs=1e-6) and not got["south"].north


def test_round_trips_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 3000), rng.uniform(-84, 84, 3000), strict=True)] + [(180.0, 10.0), (-180.0, -10.0), (179.999, 0.0), (None, 5.0)]
    p = spark.createDataFrame(rows, "lon double, lat double").selectExpr("lon as a", "lat as b")
    out = projection.from_utm(projection.to_utm(p, "a", "b")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.a is None:
            assert r.easting is None and r.lon is None
            continue
        metres = 111_320
        assert abs((r.lon - r.a + 180) % 360 - 180) * metres * np.cos(np.radians(r.b)) < 1e-3 and abs(r.lat - r.b) * metres < 1e-3
        assert 1 <= r.zone <= 60 and 100_000 < r.easting < 900_000
    with pytest.raises(ValueError):
        projection.to_utm(p.withColumn("zone", p.a), "a", "b")


def test_a_neighbouring_zone(spark):
    p = spark.createDataFrame([(12.5, 47.0, 32)], "lon double, lat double, z int")  # a degree and a half past the zone's edge
    r = projection.from_utm(projection.to_utm(p, zone="z").drop("lon", "lat"), zone="z").first()
    assert r.lon == pytest.approx(12.5, abs=1e-9) and r.lat == pytest.approx(47.0, abs=1e-9) and r.easting > 750_000


def test_warping_a_plane_of_degrees(spark):
    from cuesta.sources.rasters import lattice, warped

    degrees = lattice(spark, 60, 60).selectExpr("grid_id", "r", "c", "2 * (9 + (c + 0.5) / 100) - 3 * (47.6 - (r + 0.5) / 100) AS z")
    gt = (520_000.0, 500.0, 0, 5_240_000.0, 0, -500.0)
    out = warped(degrees, (9.0, 0.01, 0, 47.6, 0, -0.01), lattice(spark, 20, 20, "t"), gt, 32).collect()
    back = projection.from_utm(lattice(spark, 20, 20, "t").selectExpr("r", "c", "520000 + (c + 0.5) * 500 AS easting", "5240000 - (r + 0.5) * 500 AS northing", "32 AS zone", "true AS north")).collect()
    want = {(x.r, x.c): 2 * x.lon - 3 * x.lat for x in back}
    assert len(out) == 400 and all(x.grid_id == "t" and x.z == pytest.approx(want[x.r, x.c], abs=1e-9) for x in out)
    far = warped(degrees, (9.0, 0.01, 0, 47.6, 0, -0.01), lattice(spark, 1, 1, "t"), (100_000.0, 500.0, 0, 5_240_000.0, 0, -500.0), 32).first()
    assert np.isnan(far.z)
