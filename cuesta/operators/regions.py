"""Sparse cell sets (grid_id, r, c): dilation, closing, thinning, components, elongation and distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesta.operators.fixpoint import component_labels, forgotten, settled
from cuesta.operators.tiles import SIZE, TILE, spread, tile_apply

AT = ["grid_id", "r", "c"]
#: The ring around a cell, clockwise from north.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets with x² + y² <= r²."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    n = int(radius)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def _shifted(cells: DataFrame, offsets: Sequence[tuple[int, int]], keep: Sequence[str] = ()) -> DataFrame:
    by = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    out = cells.select(*AT, *keep, by.alias("_o"))
    return out.select("grid_id", (F.col("r") + F.col("_o.i")).alias("r"), (F.col("c") + F.col("_o.j")).alias("c"), *keep)


def dilate(cells: DataFrame, radius: float, keep: Sequence[str] = ()) -> DataFrame:
    """Cells within the radius of one of ``cells``, distinct unless columns are kept; not clipped to the grid."""
    out = _shifted(cells, disk(radius), keep)
    return out if keep else out.distinct()


def within(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))


def close_gaps(cells: DataFrame, height: int, width: int, size: int = 1) -> DataFrame:
    """Closing by a 3x3 square, ``size`` times each way; cells past the edge count as empty."""
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    out = cells.select(*AT)
    for _ in range(size):
        out = within(_shifted(out, square).distinct(), height, width)
    for _ in range(size):
        out = _shifted(out, square).groupBy(*AT).count().where("count = 9").select(*AT)
    return out


def _ring(cells: DataFrame) -> DataFrame:
    """cells with ring, the eight neighbours' presence (0 or 1) clockwise from north."""
    seen = F.explode(F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(k).alias("k")) for k, (i, j) in enumerate(RING))))
    heard = cells.select(*AT, seen.alias("_o")).select("grid_id", (F.col("r") + F.col("_o.i")).alias("r"), (F.col("c") + F.col("_o.j")).alias("c"), F.col("_o.k").alias("k"))
    near = heard.groupBy(*AT).agg(F.expr("bit_or(shiftleft(1, k))").alias("bits"))
    bits = F.coalesce("bits", F.lit(0))
    return cells.join(near, AT, "left").withColumn("ring", F.array(*((F.shiftright(bits, k).bitwiseAND(F.lit(1))) for k in range(8)))).drop("bits")


def ring_counts(cells: DataFrame) -> DataFrame:
    """(grid_id, r, c, neighbours, transitions): occupied neighbours and steps from empty to occupied around the ring."""
    p = _ring(cells.select(*AT))
    n = sum((F.col("ring")[k] for k in range(1, 8)), F.col("ring")[0])
    steps = [((F.col("ring")[k] == 0) & (F.col("ring")[(k + 1) % 8] == 1)).cast("int") for k in range(8)]
    return p.select(*AT, n.alias("neighbours"), sum(steps[1:], steps[0]).alias("transitions"))


def _thinned(image: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of two passes after Zhang and Suen over an array of 0 and 1; what lies outside is empty."""
    z = np.pad(image, 1).astype(np.uint8)
    for _ in range(rounds):
        for first in (True, False):
            q = [z[1 + i : z.shape[0] - 1 + i, 1 + j : z.shape[1] - 1 + j] for i, j in RING]
            n = sum(q)
            rises = sum((q[k] == 0) & (q[(k + 1) % 8] == 1) for k in range(8))
            a, b = (q[0] & q[2] & q[4], q[2] & q[4] & q[6]) if first else (q[0] & q[2] & q[6], q[0] & q[4] & q[6])
            goes = (n >= 2) & (n <= 6) & (rises == 1) & (a == 0) & (b == 0)
            z[1:-1, 1:-1] = np.where(goes, 0, z[1:-1, 1:-1])
    return z[1:-1, 1:-1]


def thin(cells: DataFrame, size: int = SIZE, reach: int = 16) -> DataFrame:
    """One-pixel skeleton: rounds of two passes until nothing goes.

    A pass looks one cell far, so a tile with a halo of two cells a round does ``reach`` rounds before tiles meet again.
    """

    def kernel(w, extent):
        left = _thinned(np.isfinite(w.of["z"]), reach)
        return {"left": left[w.halo : -w.halo, w.halo : -w.halo].astype(float)}

    now = settled(cells.select(*AT).distinct())
    count = now.count()
    while True:
        after = settled(tile_apply(now.withColumn("z", F.lit(1.0)), ["z"], 2 * reach, kernel, ["left"], size).where("left = 1").select(*AT))
        forgotten(now)
        now, before, count = after, count, after.count()
        if count == before:
            return now


def components(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, label): 8-connected components, labelled by their first cell (grid, row, column).

    Tiles label on their own; labels that meet over a seam are joined as a graph, which holds no cell of a tile's inside.
    """

    def kernel(table):
        r, c = table["r"].to_numpy().astype(np.int64), table["c"].to_numpy().astype(np.int64)
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        place = {x: i for i, x in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
        root = list(range(len(r)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (a, b), i in place.items():
            for di, dj in RING:
                j = place.get((a + di, b + dj))
                if j is not None and j < i:
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
        first = np.array([top(i) for i in range(len(r))], dtype=np.int64)
        grids = pa.array([table["grid_id"][0].as_py()] * len(r), pa.string())
        return pa.table({"grid_id": grids} | {n: pa.array(v, pa.int32()) for n, v in (("r", r), ("c", c), ("fr", r[first]), ("fc", c[first]))})

    own = settled(spread(cells.select(*AT).distinct(), 0, size).groupBy(*TILE).applyInArrow(kernel, "grid_id string, r int, c int, fr int, fc int"))
    rim = own.where(f"pmod(r, {size}) IN (0, {size - 1}) OR pmod(c, {size}) IN (0, {size - 1})")
    moved = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in RING)))
    node = F.struct("grid_id", F.col("fr").alias("r"), F.col("fc").alias("c"))
    near = rim.select(node.alias("a"), "grid_id", moved.alias("_o"), "r", "c").select("a", "grid_id", (F.col("r") + F.col("_o.i")).alias("r"), (F.col("c") + F.col("_o.j")).alias("c"))
    edges = settled(near.join(rim.select(*AT, node.alias("b")), AT).where("a <> b").select("a", "b").distinct())
    joined = component_labels(edges.select(F.col("a").alias("node")).distinct(), edges)
    name = F.coalesce("label", node)
    out = own.join(joined.select(F.col("node.grid_id").alias("grid_id"), F.col("node.r").alias("fr"), F.col("node.c").alias("fc"), "label"), ["grid_id", "fr", "fc"], "left")
    return out.select(*AT, F.concat_ws(":", name["grid_id"], name["r"].cast("string"), name["c"].cast("string")).alias("label"))


def linearity(labelled: DataFrame, least: int = 5) -> DataFrame:
    """(grid_id, n_components, mean_size, largest_size, linearity): size-weighted elongation; small components count as 0."""
    m = labelled.groupBy("grid_id", "label").agg(F.count("*").alias("n"), F.var_pop("r").alias("rr"), F.var_pop("c").alias("cc"), F.covar_pop("r", "c").alias("rc"))
    total = F.col("rr") + F.col("cc")
    gap = F.sqrt((F.col("rr") - F.col("cc")) * (F.col("rr") - F.col("cc")) + 4 * F.col("rc") * F.col("rc"))
    shape = F.when((F.col("n") >= least) & (total > 0), gap / F.when(total > 0, total)).otherwise(0.0)
    out = m.withColumn("e", shape).groupBy("grid_id")
    return out.agg(F.count("*").alias("n_components"), F.avg("n").alias("mean_size"), F.max("n").alias("largest_size"), (F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("linearity"))


def _nearest(columns: np.ndarray, rows: np.ndarray, r: int, at: np.ndarray) -> np.ndarray:
    """For each column ``at`` of row r the index of the nearest of the cells (rows, columns), one a column, in order of columns; ties to the first by (row, column).

    The lower envelope of one parabola a cell.  Squared distances times the number of cells, plus the cell's place
    among them, are different for all cells, so exact integers leave no ties.
    """
    m = len(columns)
    place = np.empty(m, np.int64)
    place[np.lexsort((columns, rows))] = np.arange(m)
    q = columns.tolist()
    high = [((r - a) ** 2 + b * b) * m + k for a, b, k in zip(rows.tolist(), q, place.tolist(), strict=True)]
    best, until = [0], []  # cells of the envelope, and the last column where each but the last is nearest
    for k in range(1, m):
        while True:
            end = (high[k] - high[best[-1]]) // (2 * m * (q[k] - q[best[-1]]))
            if until and end <= until[-1]:
                best.pop()
                until.pop()
            else:
                break
        best.append(k)
        until.append(end)
    return np.array(best)[np.searchsorted(np.array(until, dtype=np.int64), at, side="left")]


def distance(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(grid_id, r, c, distance, near_r, near_c): exact Euclidean distance to the nearest masked cell, ties to the
    first row, then column.  A column pass finds the nearest cell above and below; a pass over the rows, sorted,
    takes the lower envelope of a row's parabolas, in time linear in the row.  NULL on a grid without any."""
    marks = mask.select(*AT).distinct().withColumn("_m", F.col("r"))
    grid = pixels.select(*AT).join(marks, AT, "left")
    up = Window.partitionBy("grid_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("grid_id", "c").orderBy("r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = grid.withColumn("_u", F.last("_m", ignorenulls=True).over(up)).withColumn("_d", F.first("_m", ignorenulls=True).over(down))
    near = F.when(F.col("_d").isNull() | (F.col("r") - F.col("_u") <= F.col("_d") - F.col("r")), F.col("_u")).otherwise(F.col("_d"))
    rows = v.select("grid_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), near.cast("int").alias("near_r")).repartition("grid_id", "r").sortWithinPartitions(*AT)

    def run(batches):
        held = []

        def out():
            t = pa.Table.from_batches(held)
            c, foot = t["c"].to_numpy().astype(np.int64), t["near_r"]
            there = np.flatnonzero(foot.is_valid().to_numpy())
            r, none = int(t["r"][0].as_py()), len(there) == 0
            if none:
                empty = pa.nulls(len(c), pa.int32())
                cells = [pa.nulls(len(c), pa.float64()), empty, empty]
            else:
                feet, q = foot.drop_null().to_numpy().astype(np.int64), c[there]
                best = _nearest(q, feet, r, c)
                d = (c - q[best]) ** 2 + (r - feet[best]) ** 2
                cells = [pa.array(np.sqrt(d.astype(float))), pa.array(feet[best], pa.int32()), pa.array(q[best], pa.int32())]
            return pa.RecordBatch.from_arrays([*(t[n].combine_chunks() for n in AT), *cells], names=[*AT, "distance", "near_r", "near_c"])

        for batch in batches:
            r, g = batch.column(1).to_numpy(), batch.column(0)
            codes = g.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(r) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and (held[0].column(1)[0].as_py(), held[0].column(0)[0].as_py()) != (int(r[a]), g[a].as_py()):
                    yield out()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return rows.mapInArrow(run, "grid_id string, r int, c int, distance double, near_r int, near_c int")
