"""Sequential algorithms as NumPy kernels: over tiles of a grid with halos (see ``tiles``), and over single traces."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesta.functions.numeric import finite, known
from cuesta.operators.fixpoint import settled
from cuesta.operators.order import quantiles
from cuesta.operators.tiles import SIZE, extents, tile_apply, wave, windows

SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _dense(grid: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """The cells' bounding array, NaN where there is no row, and its first row and column."""
    r0, c0 = int(grid["r"].min()), int(grid["c"].min())
    out = np.full((int(grid["r"].max()) - r0 + 1, int(grid["c"].max()) - c0 + 1), np.nan)
    out[grid["r"].to_numpy() - r0, grid["c"].to_numpy() - c0] = grid[value].to_numpy(dtype=float)
    return out, r0, c0


def levels(z: np.ndarray, around: np.ndarray, epsilon: float) -> np.ndarray:
    """Levels of a tile's cells, inf at nodata: a flood in order of height from the tile's shores and from the levels around it.

    z has a halo of one cell; a cell beside nodata, or beside no cell, is a shore and keeps its height.  A level is the
    least over all ways to a shore of what the way makes of its height: at each step epsilon more, or the cell's own height.
    """
    hole = ~np.isfinite(z)
    shore = np.zeros(z.shape, bool)
    for i, j in SQUARE:
        shore[1:-1, 1:-1] |= hole[1 + i : hole.shape[0] - 1 + i, 1 + j : hole.shape[1] - 1 + j]
    level = np.where(hole, np.inf, around)
    level[1:-1, 1:-1] = np.where((shore & ~hole)[1:-1, 1:-1], z[1:-1, 1:-1], np.inf)
    queue = [(level[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(level)), strict=True)]
    heapq.heapify(queue)
    low, right = z.shape[0] - 1, z.shape[1] - 1
    while queue:
        now, r, c = heapq.heappop(queue)
        if now > level[r, c]:
            continue
        for i, j in SQUARE:
            a, b = r + i, c + j
            if 0 < a < low and 0 < b < right and not hole[a, b]:
                up = max(z[a, b], now + epsilon)
                if up < level[a, b]:
                    level[a, b] = up
                    heapq.heappush(queue, (up, a, b))
    return level[1:-1, 1:-1]


def flooded(z: np.ndarray, epsilon: float = 1e-4) -> np.ndarray:
    """A whole array raised so that every finite cell drains to its edge or to nodata."""
    wide = np.pad(z, 1, constant_values=np.nan)
    return np.where(np.isfinite(z), levels(wide, np.full(wide.shape, np.inf), epsilon), z)


def fill_depressions(pixels: DataFrame, epsilon: float = 1e-4, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, z) raised so that every finite cell drains to the grid's edge or to nodata.

    Tiles flood on their own and pass on the levels of their borders, until none falls.
    """

    def last(of, around, state, place):
        return {"z": np.where(np.isfinite(of["z"][1:-1, 1:-1]), state, of["z"][1:-1, 1:-1])}

    tiles = settled(windows(pixels, ["z"], size))
    return wave(tiles, ["z"], lambda of, around, place: levels(of["z"], around, epsilon), np.inf, size, last, {"z": "double"})


def whole_runs(batches):
    """Tables of batches sorted by their first column, cut only where its value changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(ids, ids[-1]))  # where the last run, which may go on, begins
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay: the farthest from the chord's line splits it while it is farther than the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.sqrt(chord[0] * chord[0] + chord[1] * chord[1])  # not hypot, whose last bit may decide between near-equal gaps
        gap = np.sqrt(rest[:, 0] * rest[:, 0] + rest[:, 1] * rest[:, 1]) if size == 0 else np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / size
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(trace_id, seq, x, y): vertices that the tolerance needs.  Traces are dealt and sorted; a task takes the whole ones of a batch."""

    def run(batches):
        for part in whole_runs(batches):
            ids = part.column(0).to_numpy()
            xy = np.column_stack([part.column(i).to_numpy() for i in (2, 3)])
            ends = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)).tolist()
            keep = np.concatenate([simplified(xy[a:b], tolerance) for a, b in zip([0, *ends], ends)])
            yield from part.filter(pa.array(keep)).to_batches()

    schema = "trace_id long, seq int, x double, y double"
    cells = points.selectExpr("cast(trace_id as long) trace_id", "cast(seq as int) seq", "cast(x as double) x", "cast(y as double) y").where("trace_id IS NOT NULL")
    return cells.repartition("trace_id").sortWithinPartitions("trace_id", "seq").mapInArrow(run, schema)


def gaussian(sigma: float, degree: int = 0) -> np.ndarray:
    """Weights of a Gaussian, cut at four sigmas, or of its first derivative."""
    radius = int(4 * sigma + 0.5)
    t = np.arange(-radius, radius + 1)
    bell = np.exp(-0.5 * (t / sigma) ** 2)
    bell /= bell.sum()
    return bell if degree == 0 else t / sigma**2 * bell


def convolved(z: np.ndarray, first: int, extent: tuple[int, int], out: tuple[int, int], weights: np.ndarray, axis: int) -> np.ndarray:
    """z along an axis at out[0] .. out[1] - 1, z starting at ``first``; past the extent of the grid its cells are mirrored, the edge cell repeated."""
    radius, n = len(weights) // 2, extent[1] - extent[0]
    at = (np.arange(out[0] - radius, out[1] + radius) - extent[0]) % (2 * n)
    wide = np.take(z, np.where(at < n, at, 2 * n - 1 - at) + extent[0] - first, axis=axis)
    return sum(w * np.take(wide, np.arange(k, k + out[1] - out[0]), axis=axis) for k, w in enumerate(weights))


class _Frame:
    """Where arrays of a tile lie within their grid: smoothing takes a part of the grid to a smaller part."""

    def __init__(self, w, extent: tuple[int, int, int, int]):
        self.extent = extent[:2], extent[2:]
        self.own = (w.tr * w.size, (w.tr + 1) * w.size), (w.tc * w.size, (w.tc + 1) * w.size)
        self.whole = self.part(w.halo)
        self.cut = tuple(slice(a - o, b - o) for (a, b), o in zip(self.whole, (w.r0, w.c0), strict=True))

    def part(self, margin: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """Rows and columns of the grid within ``margin`` of the tile."""
        return tuple((max(a - margin, lo), min(b + margin, hi)) for (a, b), (lo, hi) in zip(self.own, self.extent, strict=True))

    def smooth(self, z: np.ndarray, at, to, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """z of the part ``at``, smoothed along rows' and columns' axes, on the part ``to``."""
        z = convolved(z, at[0][0], self.extent[0], to[0], weights[0], 0)
        return convolved(z, at[1][0], self.extent[1], to[1], weights[1], 1)

    def placed(self, w, z: np.ndarray) -> np.ndarray:
        """z of the tile's part of the grid, as an array of the whole tile."""
        out = np.full((w.size, w.size), np.nan)
        (a, b), (c, d) = self.part(0)
        out[a - self.own[0][0] : b - self.own[0][0], c - self.own[1][0] : d - self.own[1][0]] = z
        return out


def _medians(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """pixels(grid_id, r, c, bands), nodata replaced by the band's median over the grid (0 without any value), and ok where no band was."""
    ok = F.lit(True)
    for b in bands:
        ok = ok & finite(b)
    out = pixels.select("grid_id", "r", "c", *bands, ok.cast("double").alias("_ok"))
    for b in bands:
        mid = quantiles(pixels.select("grid_id", known(b).alias("v")), {"_m": 0.5})
        out = out.join(mid, "grid_id", "left").withColumn(b, F.when(finite(b), F.col(b)).otherwise(F.coalesce("_m", F.lit(0.0)))).drop("_m")
    return out


def gaussian_gradient(pixels: DataFrame, sigma: float = 1.0, value: str = "z", size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, gx, gy): derivatives along columns and rows; nodata counts as the median."""
    bell, slope = gaussian(sigma), gaussian(sigma, 1)

    def kernel(w, extent):
        f = _Frame(w, extent)
        z = w.of[value][f.cut]
        return {n: f.placed(w, f.smooth(z, f.whole, f.part(0), by)) for n, by in (("gx", (bell, slope)), ("gy", (slope, bell)))}

    return tile_apply(_medians(pixels, [value]), [value], len(bell) // 2, kernel, ["gx", "gy"], size)


def structure_tensor(pixels: DataFrame, bands: list[str], sigma: float = 1.0, scale: float = 3.0, weights: list[float] | None = None, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, l1, l2, coherence): eigenvalues of the smoothed tensor summed over the bands, each with its
    weight; NaN where a band is nodata."""
    if not bands:
        raise ValueError("a tensor needs a band")
    shares = [1.0] * len(bands) if weights is None else list(weights)
    if len(shares) != len(bands):
        raise ValueError("one weight for each band is needed")
    bell, slope, wide = gaussian(sigma), gaussian(sigma, 1), gaussian(scale)
    outer = len(wide) // 2

    def kernel(w, extent):
        f = _Frame(w, extent)
        mid, own = f.part(outer), f.part(0)
        parts = np.zeros((3, mid[0][1] - mid[0][0], mid[1][1] - mid[1][0]))
        for band, share in zip(bands, shares, strict=True):
            z = w.of[band][f.cut]
            gx, gy = f.smooth(z, f.whole, mid, (bell, slope)), f.smooth(z, f.whole, mid, (slope, bell))
            parts = parts + share * np.stack([gx * gx, gx * gy, gy * gy])
        xx, xy, yy = (f.smooth(p, mid, own, (wide, wide)) for p in parts)
        mean, gap = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
        l1, l2 = mean + gap, mean - gap
        ok = w.of["_ok"][w.halo : w.halo + w.size, w.halo : w.halo + w.size] > 0
        return {n: np.where(ok, f.placed(w, v), np.nan) for n, v in (("l1", l1), ("l2", l2), ("coherence", (l1 - l2) / (l1 + l2 + 1e-12)))}

    return tile_apply(_medians(pixels, bands), [*bands, "_ok"], outer + len(bell) // 2, kernel, ["l1", "l2", "coherence"], size)


def cheapest(cost: np.ndarray, seed: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(distance, predecessor as a flat index or -1) over eight neighbours; a step costs the mean of its ends by its length."""
    height, width = cost.shape
    dist = np.full(cost.shape, np.inf)
    back = np.full(cost.shape, -1, dtype=np.int64)
    dist[seed] = 0.0
    queue = [(0.0, *seed)]
    while queue:
        d, r, c = heapq.heappop(queue)
        if d > dist[r, c]:
            continue
        for i, j in SQUARE:
            a, b = r + i, c + j
            if 0 <= a < height and 0 <= b < width and np.isfinite(cost[a, b]):
                far = d + (cost[r, c] + cost[a, b]) / 2 * (2**0.5 if i and j else 1.0)
                if far < dist[a, b]:
                    dist[a, b], back[a, b] = far, r * width + c
                    heapq.heappush(queue, (far, a, b))
    return dist, back


def cheapest_way(cost: np.ndarray, seed: tuple[int, int], target: tuple[int, int]) -> list[tuple[int, int]]:
    """The cells of the path that ``cheapest`` gives from the seed to the target, empty if out of reach; it stops once the target is reached for good."""
    width = cost.shape[1] + 2
    padded = np.full((cost.shape[0] + 2, width), np.inf)
    padded[1:-1, 1:-1] = np.where(np.isfinite(cost), cost, np.inf)
    costs = padded.ravel().tolist()
    steps = [(i * width + j, 2**0.5 if i and j else 1.0) for i, j in SQUARE]
    start, end = ((r + 1) * width + c + 1 for r, c in (seed, target))
    dist, back = [np.inf] * len(costs), [-1] * len(costs)
    dist[start] = 0.0
    queue = [(0.0, start)]
    while queue:
        d, at = heapq.heappop(queue)
        if at == end:
            break
        if d > dist[at]:
            continue
        here = costs[at]
        for step, length in steps:
            to = at + step
            far = d + (here + costs[to]) / 2 * length
            if far < dist[to]:
                dist[to], back[to] = far, at
                heapq.heappush(queue, (far, to))
    path = []
    while end >= 0 and dist[end] < np.inf:
        path.append((end // width - 1, end % width - 1))
        end = back[end]
    return path[::-1]


def _relaxed(cost: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Least costs of the inner cells from what is known of the cells of a window; a step costs the mean of its ends by its length."""
    dist = dist.copy()
    queue = [(dist[r, c], r, c) for r, c in zip(*np.nonzero(np.isfinite(dist)), strict=True)]
    heapq.heapify(queue)
    last = cost.shape[0] - 1
    while queue:
        d, r, c = heapq.heappop(queue)
        if d > dist[r, c]:
            continue
        for i, j in SQUARE:
            a, b = r + i, c + j
            if 0 < a < last and 0 < b < last and np.isfinite(cost[a, b]):
                far = d + (cost[r, c] + cost[a, b]) / 2 * (2**0.5 if i and j else 1.0)
                if far < dist[a, b]:
                    dist[a, b] = far
                    heapq.heappush(queue, (far, a, b))
    return dist


def cost_to_all(costs: DataFrame, seed: tuple[int, int], value: str = "cost", margin: int | None = None, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, distance, back_r, back_c): least cost from the seed, over the square of ``margin`` cells about
    it if given; NULL predecessors at the seed and where it cannot reach.

    Costs are positive, or not finite where there is no way.  Tiles relax on their own and pass on the costs of
    their borders, until none falls; of equally good predecessors the first by row and column stands.
    """
    if margin is not None:
        costs = costs.where(f"abs(r - ({seed[0]})) <= {margin} AND abs(c - ({seed[1]})) <= {margin}")
    out = "r_lo > {0} OR r_hi <= {0} OR c_lo > {1} OR c_hi <= {1}".format(*seed)
    if extents(costs).where(out).limit(1).count():
        raise ValueError("the seed lies outside the grid")

    def known_at(around, place):
        dist = around.copy()
        dist[1:-1, 1:-1] = np.inf
        r, c = seed[0] - place[0] + 1, seed[1] - place[1] + 1
        if 0 < r <= size and 0 < c <= size:
            dist[r, c] = 0.0
        return dist

    def solve(of, around, place):
        cost = of[value]
        if (cost <= 0).any():
            raise ValueError("costs must be positive")
        return _relaxed(cost, np.where(np.isfinite(cost), known_at(around, place), known_at(np.full_like(around, np.inf), place)))[1:-1, 1:-1]

    def last(of, around, state, place):
        cost, dist = of[value], around.copy()
        dist[1:-1, 1:-1] = state
        n = size + 1
        steps = np.stack([dist[1 + i : n + i, 1 + j : n + j] + (cost[1 + i : n + i, 1 + j : n + j] + cost[1:n, 1:n]) / 2 * (2**0.5 if i and j else 1.0) for i, j in SQUARE])
        steps[~np.isfinite(steps)] = np.inf
        best = steps.argmin(axis=0)
        moves = np.array(SQUARE)
        none = ~np.isfinite(state) | (state == 0)
        r, c = np.meshgrid(np.arange(place[0], place[0] + size), np.arange(place[1], place[1] + size), indexing="ij")
        back = [np.where(none, None, (at + moves[best, k]).astype(object)) for k, at in enumerate((r, c))]
        return {"distance": state, "back_r": back[0], "back_c": back[1]}

    tiles = settled(windows(costs, [value], size))
    return wave(tiles, [value], solve, np.inf, size, last, {"distance": "double", "back_r": "int", "back_c": "int"})


def accumulated(dr: np.ndarray, dc: np.ndarray, there: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Cells that drain through each inner cell of a window, itself included, given what drains through the cells around; 0 where there is none."""
    n = there.shape[0]
    flat = np.arange(n * n)
    moves = there & np.isfinite(dr) & np.isfinite(dc)
    to = np.full(n * n, -1)
    at = np.flatnonzero(moves)
    r, c = at // n + dr.flat[at].astype(np.int64), at % n + dc.flat[at].astype(np.int64)
    within = (r > 0) & (r < n - 1) & (c > 0) & (c < n - 1)
    to[at[within]] = r[within] * n + c[within]
    inner = np.zeros((n, n), bool)
    inner[1:-1, 1:-1] = True
    inner = (inner & there).ravel()
    held = np.where(inner, 1.0, 0.0)
    outer = ~inner & (to >= 0)
    np.add.at(held, to[outer], around.ravel()[outer])
    open_ = np.bincount(to[inner & (to >= 0)], minlength=n * n)
    ready = flat[inner & (open_ == 0)]
    while len(ready):  # cells whose upstream is settled, all at once
        ready = ready[to[ready] >= 0]
        np.add.at(held, to[ready], held[ready])
        np.subtract.at(open_, to[ready], 1)
        down = np.unique(to[ready])
        ready = down[open_[down] == 0]
    return held.reshape(n, n)[1:-1, 1:-1]
