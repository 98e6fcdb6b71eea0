"""Tiles against the whole grid: kernels with halos, floods, least costs, accumulation, thinning, components and order statistics."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesta.operators import hydrology, kernels, order, regions, tiles

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def grid(spark, named):
    rows = [(g, r, c, float(v)) for g, z in named.items() for (r, c), v in np.ndenumerate(np.asarray(z, dtype=float))]
    return spark.createDataFrame(rows, "grid_id string, r int, c int, z double").repartition(5)


def arrays(frame, shapes, *names):
    out = {g: [np.full(s, np.nan) for _ in names] for g, s in shapes.items()}
    for x in frame.collect():
        for k, n in enumerate(names):
            out[x.grid_id][k][x.r, x.c] = np.nan if x[n] is None else x[n]
    return out


@pytest.fixture(scope="module")
def land():
    rng = np.random.default_rng(5)
    rough = {}
    for g, (h, w) in {"a": (37, 41), "b": (16, 16), "c": (1, 9), "d": (5, 50)}.items():
        z = rng.normal(size=(h, w)).cumsum(axis=0).cumsum(axis=1) + rng.normal(size=(h, w)) * 3
        z[rng.random(z.shape) < 0.02] = np.nan
        rough[g] = np.round(z, 2)
    return rough


def mirrored(z, weights, axis):
    radius = len(weights) // 2
    n = z.shape[axis]
    at = np.arange(-radius, n + radius) % (2 * n)
    wide = np.take(z, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
    return sum(w * np.take(wide, np.arange(k, k + n), axis=axis) for k, w in enumerate(weights))


def test_gradient_and_tensor_of_tiles_are_those_of_the_grid(spark, land):
    p, shapes = grid(spark, land), {g: z.shape for g, z in land.items()}
    got = arrays(kernels.gaussian_gradient(p, 1.0, size=8), shapes, "gx", "gy")
    both = arrays(kernels.structure_tensor(p, ["z"], size=8), shapes, "l1", "l2", "coherence")
    bell, slope, wide = kernels.gaussian(1.0), kernels.gaussian(1.0, 1), kernels.gaussian(3.0)
    for g, z in land.items():
        full = np.where(np.isfinite(z), z, np.median(z[np.isfinite(z)]))
        gx, gy = mirrored(mirrored(full, bell, 0), slope, 1), mirrored(mirrored(full, slope, 0), bell, 1)
        assert np.array_equal(got[g][0], gx) and np.array_equal(got[g][1], gy)
        xx, xy, yy = (mirrored(mirrored(q, wide, 0), wide, 1) for q in (gx * gx, gx * gy, gy * gy))
        mean, gap = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
        want = [np.where(np.isfinite(z), v, np.nan) for v in (mean + gap, mean - gap, 2 * gap / (2 * mean + 1e-12))]
        assert np.array_equal(both[g][0], want[0], equal_nan=True) and np.array_equal(both[g][1], want[1], equal_nan=True)
        assert np.allclose(both[g][2], want[2], equal_nan=True)


def flood(z, epsilon):
    """The whole grid at once, from its edges and from nodata."""
    wide = np.pad(z, 1, constant_values=np.nan)
    hole = ~np.isfinite(wide)
    level = np.full(wide.shape, np.inf)
    queue = []
    for r, c in zip(*np.nonzero(~hole), strict=True):
        if any(hole[r + i, c + j] for i, j in AROUND):
            level[r, c] = wide[r, c]
            queue.append((wide[r, c], r, c))
    heapq.heapify(queue)
    while queue:
        now, r, c = heapq.heappop(queue)
        for i, j in AROUND:
            a, b = r + i, c + j
            if not hole[a, b] and max(wide[a, b], now + epsilon) < level[a, b]:
                level[a, b] = max(wide[a, b], now + epsilon)
                heapq.heappush(queue, (level[a, b], a, b))
    return np.where(np.isfinite(z), level[1:-1, 1:-1], np.nan)


def test_floods_cross_tiles(spark, land):
    bowl = np.add.outer(np.abs(np.arange(33) - 16.0), np.abs(np.arange(33) - 16.0))
    bowl[0, :] = bowl[-1, :] = bowl[:, 0] = bowl[:, -1] = 50
    bowl[0, 5] = 3  # one spill, many tiles from the bottom
    named = {**land, "bowl": bowl}
    got = arrays(kernels.fill_depressions(grid(spark, named), 1e-3, size=8), {g: z.shape for g, z in named.items()}, "z")
    for g, z in named.items():
        assert np.array_equal(got[g][0], flood(z, 1e-3), equal_nan=True)
    inner = got["bowl"][0][1:-1, 1:-1]
    assert (inner > 3).all()


def test_least_costs_cross_tiles(spark):
    rng = np.random.default_rng(8)
    cost = rng.uniform(0.1, 3, (30, 35))
    cost[10, :30] = np.inf  # a wall with a way round
    cost[20, 5:] = np.nan
    dist, _ = kernels.cheapest(cost, (3, 4))
    p = grid(spark, {"a": cost}).withColumnRenamed("z", "cost")
    rows = kernels.cost_to_all(p, (3, 4), size=7).collect()
    assert len(rows) == cost.size
    by = {(x.r, x.c): x for x in rows}
    for x in rows:
        assert x.distance == dist[x.r, x.c]
        if x.back_r is None:
            assert (x.r, x.c) == (3, 4) or x.distance == float("inf")
        else:
            b = by[x.back_r, x.back_c]
            assert max(abs(x.r - b.r), abs(x.c - b.c)) == 1
            assert x.distance == b.distance + (cost[b.r, b.c] + cost[x.r, x.c]) / 2 * (2**0.5 if x.r != b.r and x.c != b.c else 1.0)
    with pytest.raises(ValueError):
        kernels.cost_to_all(p, (99, 0))


def test_accumulation_crosses_tiles(spark, land):
    p = kernels.fill_depressions(grid(spark, land), 1e-3, size=8)
    steps = hydrology.flow_directions(p).cache()
    got = {(x.grid_id, x.r, x.c): x.accumulation for x in hydrology.flow_accumulation(steps, size=8).collect()}
    rows = steps.collect()
    to = {(x.grid_id, x.r, x.c): (x.grid_id, x.r + x.dr, x.c + x.dc) if x.dr is not None else None for x in rows if np.isfinite(x.z)}
    want = dict.fromkeys(to, 0)
    for cell in to:
        while cell:
            want[cell] += 1
            cell = to[cell]
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(v == 0 for k, v in got.items() if k not in want) and len(got) == len(rows)


def test_one_long_basin(spark):
    """A channel that winds through every tile: its outlet drains all cells."""
    z, level, cells = np.full((24, 24), np.nan), 1e4, []
    for r in range(0, 24, 2):
        cells += [(r, c) for c in (range(24) if r % 4 == 0 else range(23, -1, -1))] + ([(r + 1, 23 if r % 4 == 0 else 0)] if r < 22 else [])
    for cell in cells:
        z[cell], level = level, level - 1
    out = hydrology.flow_accumulation(hydrology.flow_directions(grid(spark, {"a": z})), size=6)
    assert out.agg(F.max("accumulation")).first()[0] == len(cells)


def whole_thin(img):
    img = np.pad(img, 1).astype(int)
    while True:
        before = img.copy()
        for first in (True, False):
            q = [np.roll(img, (-i, -j), (0, 1)) for i, j in regions.RING]
            n, steps = sum(q), sum((q[k] == 0) & (q[(k + 1) % 8] == 1) for k in range(8))
            a, b = (q[0] * q[2] * q[4], q[2] * q[4] * q[6]) if first else (q[0] * q[2] * q[6], q[0] * q[4] * q[6])
            img = np.where((img == 1) & (n >= 2) & (n <= 6) & (steps == 1) & (a == 0) & (b == 0), 0, img)
        if (img == before).all():
            return img[1:-1, 1:-1]


def test_thinning_and_components_cross_tiles(spark):
    rng = np.random.default_rng(2)
    img = np.kron(rng.random((9, 11)) < 0.55, np.ones((5, 5), bool)).astype(float)
    cells = grid(spark, {"a": img}).where("z = 1").drop("z")
    thin = {(x.r, x.c) for x in regions.thin(cells, size=16, reach=3).collect()}
    assert thin == set(zip(*np.nonzero(whole_thin(img)), strict=True))
    sparse = rng.random((40, 40)) < 0.4
    got = {(x.r, x.c): x.label for x in regions.components(grid(spark, {"a": sparse}).where("z = 1"), size=9).collect()}
    label = {}
    for start in zip(*np.nonzero(sparse), strict=True):
        todo = [] if start in label else [start]
        while todo:
            r, c = todo.pop()
            if (r, c) not in label:
                label[r, c] = f"a:{start[0]}:{start[1]}"
                todo += [(r + i, c + j) for i, j in AROUND if 0 <= r + i < 40 and 0 <= c + j < 40 and sparse[r + i, c + j]]
    assert got == {(int(r), int(c)): v for (r, c), v in label.items()}


def test_quantiles_and_places(spark):
    rng = np.random.default_rng(4)
    by = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0], [900, 100]), "c": np.array([7.0]), "d": np.array([])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in by.items() for v in x] + [("a", None), ("d", None)], "grid_id string, v double").repartition(7)
    shares = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0}
    got = {x.grid_id: x for x in order.quantiles(rows, shares).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, x in got.items():
        assert [x[n] for n in shares] == pytest.approx([np.quantile(by[g], s) for s in shares.values()], rel=1e-12)
    placed = order.placed(rows.where("v is not null"), "grid_id", [-F.col("v")]).collect()
    for g, x in by.items():
        mine = sorted((p.place, p.v) for p in placed if p.grid_id == g)
        assert [p for p, _ in mine] == list(range(1, len(x) + 1))
        assert [v for _, v in mine] == sorted(x, reverse=True)


def test_distance_of_wide_rows(spark):
    rng = np.random.default_rng(6)
    z = (rng.random((3, 4000)) < 0.002).astype(float)
    z[1, 7] = 1
    z[0, 100] = z[2, 100] = z[1, 96] = z[1, 104] = 1  # ties
    p = grid(spark, {"a": z, "none": np.zeros((2, 3))})
    got = {(x.r, x.c): x for x in regions.distance(p, p.where("z = 1")).collect() if x.grid_id == "a"}
    marks = np.argwhere(z == 1)
    for (r, c), x in got.items():
        d = (marks[:, 0] - r) ** 2 + (marks[:, 1] - c) ** 2
        first = min((int(k), int(a), int(b)) for k, (a, b) in zip(d, marks, strict=True))
        assert (round(x.distance**2), x.near_r, x.near_c) == first
    assert regions.distance(p, p.where("z = 1")).where("grid_id = 'none' AND distance IS NULL").count() == 6


def test_windows_drop_halos_without_cells(spark):
    made = tiles.windows(grid(spark, {"a": np.ones((8, 8))}), ["z"], 8)
    assert made.count() == 1
