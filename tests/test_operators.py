"""Analytic cases: planes, floods, paths, thin lines, thresholds."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from cuesta.operators import attitude, directional, hydrology, kernels, polyline, regions, scoring


def grid(spark, z):
    z = np.asarray(z, dtype=float)
    cells = [("g", int(r), int(c), float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(cells, "grid_id string, r int, c int, z double")


@pytest.mark.parametrize("dip", [10, 30, 55, 80])
@pytest.mark.parametrize("direction", [0, 45, 90, 135, 200, 300])
def test_plane_recovery_kernel(dip, direction):
    t = np.linspace(0, 6, 40)
    x, y = 100 * t, 80 * np.sin(t)
    a = math.radians(direction)
    z = -math.tan(math.radians(dip)) * (x * math.sin(a) + y * math.cos(a))
    p = np.column_stack([x, y, z])
    p -= p.mean(axis=0)
    got_dip, got_direction = attitude._attitudes(p.T @ p)
    assert got_dip == pytest.approx(dip, abs=1e-3)
    assert abs((got_direction - direction + 180) % 360 - 180) < 1e-3


def test_plane_recovery_columns(spark):
    rows = []
    cases = [(d, a) for d in (10, 30, 55, 80) for a in (0, 45, 90, 135, 200, 300)]
    for i, (dip, direction) in enumerate(cases):
        a = math.radians(direction)
        for t in np.linspace(0, 6, 40):
            x, y = float(5e5 + 100 * t), float(3e6 + 80 * math.sin(t))
            rows.append((i, x, y, -math.tan(math.radians(dip)) * ((x - 5e5) * math.sin(a) + (y - 3e6) * math.cos(a))))
    fits = attitude.fit_planes(spark.createDataFrame(rows, "trace_id long, x double, y double, z double")).collect()
    assert len(fits) == len(cases)
    for f in fits:
        dip, direction = cases[f.trace_id]
        assert f.dip == pytest.approx(dip, abs=1e-2)
        assert abs((f.dip_direction - direction + 180) % 360 - 180) < 1e-2


def test_east_dipping_surface(spark):
    z = np.tile(-math.tan(math.radians(15)) * 10 * np.arange(60), (60, 1))
    trace = spark.createDataFrame([(1, 0, 50.0, -50.0), (1, 1, 400.0, -50.0), (1, 2, 400.0, -400.0)], "trace_id long, seq int, x double, y double")
    f = attitude.fit_traces(trace, grid(spark, z), (0, 10, 0, 0, 0, -10), 10.0).first()
    assert f.dip == pytest.approx(15, abs=0.5)
    assert f.dip_direction == pytest.approx(90, abs=1.5)


def test_flood_leaves_no_pit():
    z = np.full((5, 5), 9.0)
    z[2, 2] = 1.0
    out = kernels.flooded(z)
    assert np.array_equal(out[[0, -1], :], z[[0, -1], :])  # the edge stays
    inner = out[1:-1, 1:-1]
    assert np.all((inner > 9.0) & (inner < 9.001))  # flats slope to the edge by the least step
    assert out[2, 2] > out[1, 2]


def test_accumulation_on_a_ramp(spark):
    z = np.tile(np.arange(6, 0, -1.0)[:, None], (1, 4))
    acc = {(x.r, x.c): x.accumulation for x in hydrology.flow_accumulation(hydrology.flow_directions(grid(spark, z))).collect()}
    assert sum(acc[5, c] for c in range(4)) == 24
    assert acc[0, 0] == 1


def test_thin_keeps_a_line(spark):
    z = np.zeros((9, 12))
    z[3:6, 1:11] = 1
    left = {(x.r, x.c) for x in regions.thin(grid(spark, z).where("z = 1")).collect()}
    assert left
    assert {r for r, _ in left} == {4}


def test_distance_against_brute_force(spark):
    rng = np.random.default_rng(3)
    z = (rng.random((12, 15)) < 0.05).astype(float)
    z[2, 3] = 1
    marks = np.argwhere(z == 1)
    p = grid(spark, z)
    for x in regions.distance(p, p.where("z = 1")).collect():
        assert x.distance == pytest.approx(min(math.hypot(x.r - a, x.c - b) for a, b in marks))


def test_least_cost_is_straight_on_even_ground():
    dist, _ = kernels.cheapest(np.ones((5, 7)), (0, 0))
    assert dist[0, 6] == pytest.approx(6)
    assert dist[4, 4] == pytest.approx(4 * math.sqrt(2))


def test_simplify():
    points = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], dtype=float)
    assert kernels.simplified(points, 1.0).tolist() == [True, False, True, True, True]


def test_simplify_measures_as_its_sql(spark):
    x = [137.7, 206.5, 56.9, 231.5, 210.5, 365.6, 209.1, 451.9, 435.9]
    y = [224.1, 94.5, 397.7, 79.5, 386.5, 24.8, 100.3, 252.7, 464.7]

    def stay(a, b):
        size = np.sqrt((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)
        gaps = [abs((x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a])) / size for k in range(a + 1, b)]
        k = int(np.argmax(gaps)) if gaps else 0
        return stay(a, a + 1 + k) | stay(a + 1 + k, b) if gaps and gaps[k] > 50 else {a, b}

    rows = [(t, k + 1, x[k], y[k]) for t in (3, 1, 2) for k in range(9)]
    got = kernels.simplify(spark.createDataFrame(rows, "trace_id long, seq int, x double, y double"), 50.0).collect()
    assert sorted((p.trace_id, p.seq) for p in got) == [(t, k + 1) for t in (1, 2, 3) for k in sorted(stay(0, 8))]


def test_auc_counts_ties(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 2.0), (0, 1.0), (0, 3.0)], "pos int, v double")
    assert scoring.auc(s).first().auc == pytest.approx(0.5)


def test_lone_value_is_its_own_threshold(spark):
    s = spark.createDataFrame([(1, 1.0), (0, 1.0)], "pos int, v double")
    assert scoring.youden(s).first().threshold == 1.0


def test_budget_is_checked(spark):
    with pytest.raises(ValueError):
        scoring.top_cells(grid(spark, [[1.0]]), 0)


def test_fisher_example(spark):
    v = spark.createDataFrame([(0.0, 0.0, -1.0), (0.0, 0.1, -1.0), (0.1, 0.0, -1.0)], "x double, y double, z double")
    f = directional.fisher_mean(v).first()
    assert f.n == 3
    assert f.plunge > 80
    assert f.kappa > 100


def test_bilinear_is_exact_on_a_plane(spark):
    r, c = np.mgrid[0:8, 0:9]
    p = spark.createDataFrame([(33.0, -27.0), (1.0, -27.0)], "x double, y double")
    got = polyline.sample_bilinear(p, grid(spark, 2 * c - 3 * r), (0, 10, 0, 0, 0, -10)).orderBy("x").collect()
    assert math.isnan(got[0].z)
    assert got[1].z == pytest.approx(2 * 2.8 - 3 * 2.2)


def test_stepped_knows_neighbours_without_sorting_points(spark):
    rows = [(t, k, float(x), float(y)) for t, line in enumerate([[(0, 0), (3.3, 1), (3.3, 1), (3.4, 9.7)], [(1, 1), (1, 1.2)], [(5, 5)]]) for k, (x, y) in enumerate(line, 1)]
    points = spark.createDataFrame(rows, "trace_id int, seq int, x double, y double")
    got = sorted(tuple(p) for p in polyline.stepped(points, 1.0).collect())
    dense = sorted(tuple(p) for p in polyline.densify(points, 1.0).collect())
    assert [p[:5] for p in got] == dense
    for t in (0, 1):
        mine = [p for p in got if p[0] == t]
        for i, p in enumerate(mine):
            a, b = mine[max(i - 1, 0)], mine[min(i + 1, len(mine) - 1)]
            assert p[5:] == (b[3] - a[3], b[4] - a[4])


def test_deviations_of_dense_points_need_no_visit_to_each_pair():
    """10,000 centres with some 45,000 neighbours each; a few of them against all pairs, dips with and without ties."""
    rng = np.random.default_rng(4)
    n, radius = 200_000, 500.0
    x, y, angle = rng.uniform(0, 1600, n), np.floor(rng.uniform(0, 1600, n)), rng.uniform(0, np.pi, n)
    dip = np.where(x < 800, np.floor(rng.uniform(0, 90, n)), rng.uniform(0, 90, n))
    ids = np.where(np.arange(n) % 7 == 0, np.arange(n) // 2, np.arange(n))  # some ids twice
    s, c = np.sin(angle), np.cos(angle)
    around = pd.DataFrame({"n_id": ids, "n_x": x, "n_y": y, "n_dip": dip, "n_s": s, "n_c": c})
    centres = pd.DataFrame({"id": ids, "x": x, "y": y, "strike": angle, "dip": dip}).iloc[:10_000]
    begun = time.process_time()
    got = attitude._neighbours(centres, around, radius)
    assert time.process_time() - begun < 15  # all pairs took milliseconds a centre
    for k in range(0, 10_000, 500):
        at = ((x[k] - x) ** 2 + (y[k] - y) ** 2 <= radius * radius) & (ids != ids[k])
        row = got.iloc[k]
        assert (row.n, row.dip_mid) == (at.sum(), np.median(dip[at]))
        assert abs(row.s - s[at].mean()) < 1e-12 and abs(row.c - c[at].mean()) < 1e-12
