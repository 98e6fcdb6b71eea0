"""Planes through sampled traces: strike, dip, uncertainty, gates, and their local variability."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesta.functions.angles import azimuth, doubled, mean_strike, strike_difference
from cuesta.functions.grid import Transform
from cuesta.functions.numeric import nan, finite, held, modulo, or_nan
from cuesta.functions.symmetric import eigenvalues2, eigenvalues3, eigenvector3
from cuesta.operators.polyline import lengths, sample_trace

FIT_COLUMNS = ["strike", "dip", "dip_direction", "conditioning", "planarity", "residual_rms", "relief", "n_samples", "map_conditioning"]


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def _moments(samples: DataFrame, least: int, names: tuple[str, ...]) -> DataFrame:
    """(trace_id, centred second moments, n_samples, relief) of each trace of ``least`` samples or more."""
    products = [(F.count("*") * (F.var_pop(a) if a == b else F.covar_pop(a, b))).alias(a + b) for a, b in names]
    return samples.groupBy("trace_id").agg(*products, F.count("*").cast("int").alias("n_samples"), (F.max("z") - F.min("z")).alias("relief")).where(F.col("n_samples") >= least)


def _map_conditioning() -> Column:
    big, small = eigenvalues2(F.col("xx"), F.col("xy"), F.col("yy"))
    return _share(F.greatest(small, F.lit(0.0)), big).alias("map_conditioning")


def map_shapes(samples: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, n_samples, relief, map_conditioning) as of ``fit_planes``, without the planes."""
    return _moments(samples, least, ("xx", "yy", "xy")).select("trace_id", "n_samples", "relief", _map_conditioning())


def fit_planes(samples: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, FIT_COLUMNS) of samples(trace_id, x, y, z): the least-squares plane of each trace of ``least`` samples or more.

    One aggregation of Spark's running central moments (large coordinates do not cancel), so the
    many samples are neither sorted nor held; the eigen problem is solved in columns.
    """
    if least < 3:
        raise ValueError("a plane needs three samples")
    m = _moments(samples, least, ("xx", "yy", "zz", "xy", "xz", "yz"))
    names = [F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")]
    one, two, three = eigenvalues3(*names)
    m = held(m, {"l1": F.greatest(one, F.lit(0.0)), "l2": F.greatest(two, F.lit(0.0)), "l3": F.greatest(three, F.lit(0.0)), "_l": three})
    nx, ny, nz = eigenvector3(F.col("_l"), *names)
    m = held(m, {"nx": nx, "ny": ny, "nz": nz})
    up = F.when(F.col("nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    m = m.withColumns({"nx": up * F.col("nx"), "ny": up * F.col("ny"), "nz": up * F.col("nz")})
    direction = F.when((F.col("nx") == 0) & (F.col("ny") == 0), F.lit(0.0)).otherwise(azimuth(F.col("nx"), F.col("ny")))
    m = m.withColumn("dip_direction", direction)
    return m.select(
        "trace_id",
        modulo(F.col("dip_direction") - 90, 360).alias("strike"),
        F.degrees(F.acos(F.least(F.col("nz"), F.lit(1.0)))).alias("dip"),
        "dip_direction",
        _share(F.col("l2"), F.col("l1")).alias("conditioning"),
        _share(F.col("l3"), F.col("l2")).alias("planarity"),
        F.sqrt(F.col("l3") / F.col("n_samples")).alias("residual_rms"),
        "relief",
        "n_samples",
        _map_conditioning(),
    )


def _attitudes(tensors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dip, dip direction) of the planes whose normal is the least axis of each 3x3 scatter matrix."""
    normal = np.linalg.eigh(tensors)[1][..., 0]
    normal = np.where(normal[..., 2:3] < 0, -normal, normal)
    dip = np.degrees(np.arccos(np.clip(normal[..., 2], -1, 1)))
    return dip, np.degrees(np.arctan2(normal[..., 0], normal[..., 1])) % 360


class _Noise:
    """The seeded draws for traces of n samples: heights' noise, centred, and the tilts.  Every trace has the same seed, so
    those of one length share them.  Rows are drawn in blocks of bounded size; ``blocks`` yields (rows, noise)."""

    LARGEST = 1 << 22

    def __init__(self, n: int, sigma_z: float, n_mc: int, seed: int, length: float | None):
        self.n, self.sigma, self.n_mc, self.seed = n, sigma_z, n_mc, seed
        self.kept = [*self._drawn()] if n * n_mc <= self.LARGEST else None
        rng = self.rng if self.kept is not None else None
        if rng is None:
            for _ in self._drawn():
                pass
            rng = self.rng
        self.tilt = rng.normal(0.0, sigma_z / length, (n_mc, 2)) if length and length > 0 else np.zeros((n_mc, 2))

    def _drawn(self):
        self.rng = np.random.default_rng(self.seed)
        step = max(1, self.LARGEST // self.n)
        for lo in range(0, self.n_mc, step):
            hi = min(self.n_mc, lo + step)
            z = self.rng.normal(0.0, self.sigma, (hi - lo, self.n))
            yield slice(lo, hi), z - z.mean(axis=1, keepdims=True)

    def blocks(self):
        return self.kept if self.kept is not None else self._drawn()


def _perturbed(points: np.ndarray, noise: _Noise) -> tuple[np.ndarray, np.ndarray]:
    """(dip, dip direction) uncertainties in degrees of m traces of n samples, points[m, n, 3].

    Noise moves heights only, so of a sample's scatter matrix only the row and column of z are made anew, from the
    products of the noise with the coordinates.
    """
    centred = points - points.mean(axis=1, keepdims=True)
    flat = np.swapaxes(centred, 1, 2) @ centred  # the unperturbed scatter matrices
    m = len(points)
    scatter = np.empty((m, noise.n_mc, 3, 3))
    scatter[..., :2, :2] = flat[:, None, :2, :2]
    tilt = noise.tilt
    for rows, z in noise.blocks():
        along, t = z @ centred, tilt[rows]
        by_tilt = t @ flat[:, :2, :2]
        scatter[:, rows, 2, :2] = along[..., :2] + by_tilt + flat[:, None, 2, :2]
        own = np.einsum("ij,ij->i", z, z) + 2 * (along[..., 2] + (along[..., :2] * t).sum(axis=-1))
        scatter[:, rows, 2, 2] = own + (by_tilt * t).sum(axis=-1) + 2 * flat[:, 2, :2] @ t.T + flat[:, None, 2, 2]
    scatter[..., :2, 2] = scatter[..., 2, :2]
    dip, direction = _attitudes(scatter)
    a = np.radians(direction)
    r = np.minimum(1.0, np.hypot(np.sin(a).mean(axis=1), np.cos(a).mean(axis=1)))
    return dip.std(axis=1), np.degrees(np.sqrt(np.maximum(0.0, -2 * np.log(np.maximum(r, 1e-12)))))


def monte_carlo(points: np.ndarray, sigma_z: float, n_mc: int = 200, seed: int = 0, correlation_length: float | None = 500.0) -> tuple[float, float]:
    """(dip, dip direction) uncertainty in degrees from noise of the heights and a random tilt common to the trace."""
    dip, direction = _perturbed(points[None], _Noise(len(points), sigma_z, n_mc, seed, correlation_length))
    return float(dip[0]), float(direction[0])


#: Traces of one length that are perturbed together, lengths whose noise a task keeps, and vertices whose samples a task sorts.
TOGETHER, LENGTHS_KEPT, DEALT = 256, 64, 1 << 16


def _parts(points: DataFrame) -> int | None:
    """Tasks for the samples of points, so that a task's share does not grow with them; None while the session's are enough."""
    parts = -(-points.count() // DEALT)
    return parts if parts > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def uncertainties(samples: DataFrame, sigma_z: float = 2.0, n_mc: int = 200, seed: int = 0, correlation_length: float | None = 500.0, parts: int | None = None) -> DataFrame:
    """(trace_id, dip_uncertainty, dip_direction_uncertainty): a seeded Monte Carlo of every trace; NaN below three samples.

    Samples are dealt (over ``parts`` tasks, if given) and sorted by trace; a task takes the whole traces of a batch, those
    of one length at once.
    """

    def run(batches):
        noise: dict[int, _Noise] = {}

        def solved(ids: np.ndarray, xyz: np.ndarray):
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            n = np.diff(np.append(first, len(ids)))
            dip, direction = np.full(len(first), np.nan), np.full(len(first), np.nan)
            for size in np.unique(n[(n >= 3) & (sigma_z > 0)]).tolist():
                if size not in noise:
                    while len(noise) >= LENGTHS_KEPT:
                        noise.pop(next(iter(noise)))
                    noise[size] = _Noise(size, sigma_z, n_mc, seed, correlation_length)
                mine = np.flatnonzero(n == size)
                step = max(1, min(TOGETHER, _Noise.LARGEST // size))
                for part in (mine[i : i + step] for i in range(0, len(mine), step)):
                    dip[part], direction[part] = _perturbed(xyz[first[part][:, None] + np.arange(size)], noise[size])
            return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(dip), pa.array(direction)], names=["trace_id", "dip_uncertainty", "dip_direction_uncertainty"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            xyz = np.column_stack([batch.column(i).to_numpy() for i in range(1, 4)])
            cut = int(np.searchsorted(ids, ids[-1]))  # where the last trace, which may go on, begins
            if cut:
                whole = [*held, (ids[:cut], xyz[:cut])]
                yield solved(np.concatenate([w[0] for w in whole]), np.concatenate([w[1] for w in whole]))
                held = []
            elif held and held[-1][0][-1] != ids[0]:
                yield solved(np.concatenate([w[0] for w in held]), np.concatenate([w[1] for w in held]))
                held = []
            held.append((ids[cut:], xyz[cut:]))
        if held:
            yield solved(np.concatenate([w[0] for w in held]), np.concatenate([w[1] for w in held]))

    cells = samples.select(F.col("trace_id").cast("long").alias("trace_id"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z")), "seq", "k")
    dealt = cells.repartition(*([parts] if parts else []), "trace_id").sortWithinPartitions("trace_id", "seq", "k").drop("seq", "k")
    return dealt.mapInArrow(run, "trace_id long, dip_uncertainty double, dip_direction_uncertainty double")


def reliable(conditioning: float = 1e-2, map_conditioning: float = 1e-3) -> Column:
    """The gate on a fit's conditioning in space and on the map."""
    return (F.col("conditioning") >= conditioning) & (F.col("map_conditioning") >= map_conditioning)


def relief_ok(least: float = 80.0) -> Column:
    """The recommended confidence rule on relief."""
    return F.col("relief") >= least


def fit_traces(points: DataFrame, pixels: DataFrame, gt: Transform, res: float = 30.0, sigma_z: float | None = None, min_trace_pts: int = 8, conditioning: float = 1e-2, map_conditioning: float = 1e-3, location: str = "vertices") -> DataFrame:
    """(trace_id, x, y, fit, [uncertainty,] reliable): attitudes of world-space traces over a surface.

    location is the mean of the vertices or of the samples.
    """
    samples = sample_trace(points, pixels, gt, res)
    fits = fit_planes(samples, max(3, min_trace_pts)).where(finite("dip"))
    if sigma_z:
        # the costly kernel runs only where it counts; the ids are few beside the samples, which a merge join would sort
        enough = samples.join(fits.select("trace_id").hint("shuffle_hash"), "trace_id", "left_semi")
        fits = fits.join(uncertainties(enough, sigma_z, parts=_parts(points)), "trace_id")
    place = (points if location == "vertices" else samples).groupBy("trace_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return place.join(fits, "trace_id").withColumn("reliable", reliable(conditioning, map_conditioning))


def fit_region(points: DataFrame, pixels: DataFrame, gt: Transform, res: float = 30.0) -> DataFrame:
    """The regional form: five samples are enough, both gates at 1e-3, located at the samples' mean, with lengths."""
    fits = fit_traces(points, pixels, gt, res, min_trace_pts=5, conditioning=1e-3, map_conditioning=1e-3, location="samples")
    return fits.join(lengths(points), "trace_id")


def windowed_fits(samples: DataFrame, half: int = 4) -> DataFrame:
    """(trace_id, pos, FIT_COLUMNS): a plane for every sample from the 2 half + 1 samples around it."""
    order = Window.partitionBy("trace_id").orderBy("seq", "k")
    numbered = samples.withColumn("pos", F.row_number().over(order))
    near = numbered.select("trace_id", "x", "y", "z", F.explode(F.sequence(F.col("pos") - half, F.col("pos") + half)).alias("pos"))
    last = numbered.groupBy("trace_id").agg(F.max("pos").alias("last"))
    keyed = near.join(last, "trace_id").where((F.col("pos") > half) & (F.col("pos") <= F.col("last") - half))
    fits = fit_planes(keyed.select(F.struct("trace_id", "pos").alias("trace_id"), "x", "y", "z"))
    return fits.select("trace_id.trace_id", "trace_id.pos", *FIT_COLUMNS)


# Statistics of strikes


def mean_strikes(attitudes: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean_strike, resultant): doubled-angle statistics of the finite strikes."""
    s, c = doubled("strike")
    out = attitudes.where(finite("strike")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(s).alias("s"), F.avg(c).alias("c"))
    return out.select(*keys, "n", mean_strike(F.col("s"), F.col("c")).alias("mean_strike"), or_nan(F.hypot("s", "c")).alias("resultant"))


def mean_dip_direction(attitudes: DataFrame, *keys: str) -> DataFrame:
    a = F.radians(F.col("dip_direction"))
    out = attitudes.where(finite("dip_direction")).groupBy(*keys).agg(F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"))
    return out.select(*keys, azimuth(F.col("s"), F.col("c")).alias("mean_dip_direction"))


def radius_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Ordered pairs (a, b) of distinct points within the radius, ends included: an equi-join on cells with a residual distance.

    points(key, x, y, ...); columns come as a_* and b_*.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    cell = [F.floor(F.col(c) / float(radius)).cast("long") for c in ("x", "y")]
    left = points.select(*(F.col(c).alias(f"a_{c}") for c in points.columns), cell[0].alias("_cx"), cell[1].alias("_cy"))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    right = points.select(*(F.col(c).alias(f"b_{c}") for c in points.columns), cell[0].alias("_x"), cell[1].alias("_y"))
    right = right.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    right = right.withColumn("_cx", F.col("_x") + F.col("_i")).withColumn("_cy", F.col("_y") + F.col("_j")).drop("_x", "_y", "_i", "_j")
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return left.join(right, ["_cx", "_cy"]).where((dx * dx + dy * dy <= float(radius) ** 2) & (F.col(f"a_{key}") != F.col(f"b_{key}"))).drop("_cx", "_cy")


#: Centres of a cell that share a task, and (centre, strip) pairs or single points that are looked at together.
SHARE, BLOCK = 1 << 19, 1 << 18


def windowed_deviations(attitudes: DataFrame, radius: float, least: int = 2) -> DataFrame:
    """(id, n, strike_dev, dip_dev): each attitude against its neighbours' mean strike and median dip; NaN with too few.

    Points meet by square cells of twice the radius.  The pairs, which grow with the
    square of the density, are not visited: a kernel takes the points of a cell, in
    shares of about SHARE, and those within the radius of the cell, and counts whole
    runs of points inside a circle by running sums (``Around``).
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    s, c = doubled("strike")
    p = attitudes.select("id", *(F.col(x).cast("double").alias(x) for x in ("x", "y", "strike", "dip")), s.alias("s"), c.alias("c"))
    side = 2.0 * radius

    def cell(v: Column) -> Column:
        return F.floor(v / side).cast("long")

    centres = p.withColumn("_x", cell(F.col("x"))).withColumn("_y", cell(F.col("y")))
    sizes = centres.groupBy("_x", "_y").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("_k"))
    centres = centres.join(sizes, ["_x", "_y"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")).drop("_k")
    reach = radius * (1 + 1e-9)
    near = {v: F.explode(F.sequence(cell(F.col(v) - reach), cell(F.col(v) + reach))) for v in ("x", "y")}
    around = p.select("id", "x", "y", "dip", "s", "c", near["x"].alias("_x")).withColumn("_y", near["y"])
    around = around.join(sizes, ["_x", "_y"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    key = ["_x", "_y", "_part"]
    around = around.toDF(*(f"cell{c}" if c in key else f"n_{c}" for c in around.columns))  # names of its own: both sides come from one table
    kind = attitudes.schema["id"].dataType.simpleString()
    found = centres.groupBy(*key).cogroup(around.groupBy(*(f"cell{k}" for k in key))).applyInPandas(lambda a, b: _neighbours(a, b, radius), f"id {kind}, strike double, dip double, n long, s double, c double, dip_mid double")
    enough = F.col("n") >= least
    return found.select(
        "id",
        "n",
        F.when(enough, strike_difference("strike", mean_strike(F.col("s"), F.col("c")))).otherwise(nan()).alias("strike_dev"),
        F.when(enough, F.abs(F.col("dip") - F.col("dip_mid"))).otherwise(nan()).alias("dip_dev"),
    )


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, places): every place of start[i]..end[i] - 1, for all i."""
    size = np.maximum(end - start, 0)
    i = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    return i, np.arange(len(i)) + np.repeat(start - ends + size, size)


class Around:
    """Points in strips along x, for counts, sums and medians over circles without a visit to every point.

    A strip's points stand in order of small cells.  Of a circle's run in a strip, the cells that lie inside for
    certain count by running sums, only points of the others are tested one by one; with strips and cells about as wide
    as points are apart, both grow with the square root of the density.  Sines and cosines are summed as whole
    numbers, which leave no remainders however long the runs; the median descends a wavelet matrix of the dips' ranks.
    """

    def __init__(self, table: pd.DataFrame, radius: float):
        self.radius = radius
        x, y, dip, s, c, self.ids = (table[f"n_{k}"].to_numpy() for k in ("x", "y", "dip", "s", "c", "id"))
        n = len(x)
        self.x0, self.y0 = (float(v.min()) if n else 0.0 for v in (x, y))
        wide, high = (float(v.max()) - o if n else 0.0 for v, o in ((x, self.x0), (y, self.y0)))
        self.h = min(max(np.sqrt(wide * high / max(n, 1)), radius / 500), radius / 8)
        self.g = self.h / 2
        self.rows, self.cells = int(high / self.h) + 1, int(wide / self.g) + 1
        cell = self._row(y) * self.cells + self._cell(x)
        order = np.argsort(cell, kind="stable")
        self.x, self.y, self.ids, dip, s, c = (v[order] for v in (x, y, self.ids, dip, s, c))
        self.first = np.searchsorted(cell[order], np.arange(self.rows * self.cells + 1)).astype(np.int32)
        self.unit = 2.0 ** (61 - n.bit_length())
        self.bad = [np.isnan(s) | np.isnan(c), np.isnan(dip)]
        self.own = [np.rint(np.where(self.bad[0], 0, v) * self.unit).astype(np.int64) for v in (s, c)] + [b.astype(np.int64) for b in self.bad]
        self.sums = [np.concatenate([[0], np.cumsum(v)]) for v in self.own]
        self.values, rank = np.unique(np.where(self.bad[1], 0, dip), return_inverse=True)
        self.rank = rank.astype(np.int32)
        self.levels = []
        for bit in range(max(len(self.values) - 1, 0).bit_length() - 1, -1, -1):
            zero = (rank >> bit & 1) == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)))
            rank = np.concatenate([rank[zero], rank[~zero]])
        by = np.argsort(self.ids, kind="stable")
        self.by_id, self.sorted_ids = by, self.ids[by]

    def _row(self, y: np.ndarray) -> np.ndarray:
        return np.clip(((y - self.y0) / self.h).astype(np.int64), 0, self.rows - 1)

    def _cell(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.x0) / self.g).astype(np.int64), 0, self.cells - 1)

    def found(self, cx: np.ndarray, cy: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n, mean sine, mean cosine, median dip) of the points of other ids within the radius of each centre."""
        m, radius = len(cx), self.radius
        strips = int(2 * radius / self.h) + 3
        row = np.floor((cy - self.y0 - radius) / self.h).astype(np.int64)[:, None] + np.arange(strips)
        low = self.y0 + row * self.h - cy[:, None]  # the strip's edges from the centre
        slack = 1e-6 * self.h
        near, far = np.maximum(np.maximum(low, -low - self.h) - slack, 0), np.maximum(np.abs(low), np.abs(low + self.h)) + slack
        there = (row >= 0) & (row < self.rows) & (near <= radius)
        row = np.where(there, row, 0) * self.cells
        out, inside = np.sqrt(np.maximum(radius * radius - near * near, 0)) + slack, radius * radius - far * far
        half = np.sqrt(np.maximum(inside, 0)) - slack
        at = (cx - self.x0)[:, None]
        l, r = np.ceil((at - half) / self.g), np.floor((at + half) / self.g)  # whole cells l .. r - 1
        whole = there & (inside > 0) & (r > l)
        ol, orr = np.clip(np.floor((at - out) / self.g), 0, self.cells), np.clip(np.floor((at + out) / self.g) + 1, 0, self.cells)
        l = np.where(whole, np.clip(l, ol, orr), orr)
        r = np.where(whole, np.clip(r, l, orr), orr)
        ol, l, r, orr = (self.first[row + v.astype(np.int64)] for v in (ol, l, r, orr))
        ol, orr = np.where(there, ol, l), np.where(there, orr, r)
        a, b = l.astype(np.int64), np.where(there, r, l).astype(np.int64)
        some = [_spans(s.ravel().astype(np.int64), e.ravel().astype(np.int64)) for s, e in ((ol, a), (b, orr))]
        who, point = np.concatenate([i // strips for i, _ in some]), np.concatenate([p for _, p in some])
        same = _spans(np.searchsorted(self.sorted_ids, cid, "left"), np.searchsorted(self.sorted_ids, cid, "right"))
        who, point, weight = np.concatenate([who, same[0]]), np.concatenate([point, self.by_id[same[1]]]), np.repeat([1, -1], [len(who), len(same[0])])
        dx, dy = cx[who] - self.x[point], cy[who] - self.y[point]
        good = np.flatnonzero(dx * dx + dy * dy <= radius * radius)
        who, point, weight = who[good], point[good], weight[good]

        def total(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
            sums = (runs[b] - runs[a]).sum(axis=1)
            np.add.at(sums, who, weight * values[point])
            return sums

        n = (b - a).sum(axis=1) + np.bincount(who, weights=weight, minlength=m).astype(np.int64)
        s, c, bad, bad_dip = (total(v, runs) for v, runs in zip(self.own, self.sums, strict=True))
        divisor = np.maximum(n, 1)
        s, c = (np.where((n > 0) & (bad == 0), v / self.unit / divisor, np.nan) for v in (s, c))
        ask = np.flatnonzero((n > 0) & (bad_dip == 0))
        mid = np.full(m, np.nan)
        k = (n - 1) // 2
        if len(ask):
            of = np.full(m, -1)
            of[ask] = np.arange(len(ask))
            mine = of[who] >= 0
            args = a[ask], b[ask], of[who[mine]], self.rank[point[mine]], weight[mine]
            one, until = self._selected(*args, k[ask])
            two = one.copy()
            more = np.flatnonzero(n[ask] // 2 >= until)
            if len(more):
                of = np.full(len(ask), -1)
                of[more] = np.arange(len(more))
                mine = of[args[2]] >= 0
                two[more] = self._selected(args[0][more], args[1][more], of[args[2][mine]], args[3][mine], args[4][mine], n[ask][more] // 2)[0]
            mid[ask] = (self.values[one] + self.values[two]) / 2
        return n, s, c, mid

    def _selected(self, a: np.ndarray, b: np.ndarray, who: np.ndarray, rank: np.ndarray, weight: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th rank (from 0) of each circle, its runs a..b of strips and its single points, and how many are at most that."""
        m = len(k)
        left, found, before = k.copy(), np.zeros(m, np.int64), np.zeros(m, np.int64)
        on = np.ones(len(who), bool)
        for bit, zeros in self.levels:
            za, zb = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            low = on & ((rank >> bit & 1) == 0)
            count = (zb - za).sum(axis=1) + np.bincount(who[low], weights=weight[low], minlength=m).astype(np.int64)
            up = left >= count
            a, b = np.where(up[:, None], zeros[-1] + a - za, za), np.where(up[:, None], zeros[-1] + b - zb, zb)
            left, before = np.where(up, left - count, left), np.where(up, before + count, before)
            found |= up.astype(np.int64) << bit
            on &= (rank >> bit & 1) == up[who]
        equal = (b - a).sum(axis=1) + np.bincount(who[on], weights=weight[on], minlength=m).astype(np.int64)
        return found, before + equal


def _neighbours(centres: pd.DataFrame, around: pd.DataFrame, radius: float) -> pd.DataFrame:
    """centres with the number, mean sine and cosine, and median dip of the other points within the radius."""
    points = Around(around, radius)
    cx, cy, cid = (centres[k].to_numpy() for k in ("x", "y", "id"))
    order = np.lexsort((cx, points._row(cy))) if len(around) else np.arange(len(cx))  # neighbours in turn, whose strips are the same
    n, s, c, mid = np.zeros(len(cx), np.int64), np.full(len(cx), np.nan), np.full(len(cx), np.nan), np.full(len(cx), np.nan)
    step = max(1, BLOCK // 4 // (int(2 * radius / points.h) + 3))
    for part in (order[i : i + step] for i in range(0, len(order), step)):
        n[part], s[part], c[part], mid[part] = points.found(cx[part], cy[part], cid[part])
    return centres[["id", "strike", "dip"]].assign(n=n, s=s, c=c, dip_mid=mid)


def outliers(deviations: DataFrame, strike: float = 60.0, dip: float = 35.0) -> DataFrame:
    """deviations with review: the documented rule for a second look."""
    return deviations.withColumn("review", (finite("strike_dev") & (F.col("strike_dev") > strike)) | (finite("dip_dev") & (F.col("dip_dev") > dip)))


def variability_table(attitudes: DataFrame, radii: Sequence[float] = (250, 500, 1000, 2000), least: int = 3) -> DataFrame:
    """(radius, n, quantiles of the deviations); radii with fewer than ``least`` values are left out."""
    out = None
    for r in radii:
        d = windowed_deviations(attitudes, r).where(finite("strike_dev")).select(F.lit(float(r)).alias("radius"), "strike_dev", "dip_dev")
        out = d if out is None else out.unionByName(d)
    p = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))
    t = out.groupBy("radius").agg(F.count("*").alias("n"), F.percentile("strike_dev", p).alias("s"), F.percentile("dip_dev", p).alias("d")).where(F.col("n") >= least)
    return t.select("radius", "n", *(F.col(c)[i].alias(f"{n}_{q}") for c, n in (("s", "strike"), ("d", "dip")) for i, q in enumerate(("p50", "p90", "p95"))))


def knee_table(values: DataFrame, value: str, bins: Sequence[float], uncertainty: str = "dip_uncertainty") -> DataFrame:
    """(lo, hi, n, reliable_pct, median, p90) of half-open bins; empty bins are left out.  values has a boolean ``reliable``."""
    edges = F.array(*(F.lit(float(b)) for b in bins))
    i = F.size(F.filter(edges, lambda b: b <= F.col(value)))
    p = F.percentile(F.when(finite(uncertainty), F.col(uncertainty)), F.array(F.lit(0.5), F.lit(0.9)))
    kept = values.where(finite(value)).withColumn("_i", i).where((F.col("_i") > 0) & (F.col("_i") < len(bins)))
    out = kept.groupBy("_i").agg(F.count("*").alias("n"), (100 * F.avg(F.col("reliable").cast("double"))).alias("reliable_pct"), p.alias("_p"))
    return out.select(F.element_at(edges, F.col("_i")).alias("lo"), F.element_at(edges, F.col("_i") + 1).alias("hi"), "n", "reliable_pct", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p90"))


def pooled(values: DataFrame, value: str, key: str = "region") -> DataFrame:
    """(key, n, p90, p95) for each key and, with a NULL key, all together."""
    p = F.percentile(value, F.array(F.lit(0.9), F.lit(0.95)))
    return values.where(finite(value)).rollup(key).agg(F.count("*").alias("n"), p.alias("_p")).select(key, "n", F.col("_p")[0].alias("p90"), F.col("_p")[1].alias("p95"))
