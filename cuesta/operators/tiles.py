"""Grids as square tiles: kernels with halos, and fixpoints that tiles reach by exchanging their borders.

A task holds tiles, never a grid.  ``tile_apply`` sends every cell to its own
tile and to those whose halo it lies in, one shuffle, and gives a kernel the
window of a tile.  ``wave`` repeats a local solution: tiles show the values of
their outermost cells, those beside a changed border solve again with the new
values around them, until no border changes.  Between rounds only borders are
kept; a quiet tile costs nothing.  The rounds are as many as the tiles that the
longest dependency passes through.

Tile (tr, tc) of size n has the cells with floor(r / n) = tr, floor(c / n) = tc.
Cells that are absent are NaN in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesta.operators.fixpoint import forgotten, settled

SIZE = 256
TILE = ["grid_id", "tr", "tc"]
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def spread(pixels: DataFrame, halo: int, size: int) -> DataFrame:
    """pixels(grid_id, r, c, ...) with tr and tc: a row for every tile whose window holds the cell."""

    def reach(c: str):
        at = F.col(c).cast("long")
        return F.explode(F.sequence(F.floor((at - halo) / size).cast("int"), F.floor((at + halo) / size).cast("int")))

    return pixels.withColumn("tr", reach("r")).withColumn("tc", reach("c"))


class Window:
    """The cells of a tile and its halo: arrays by name, NaN where absent, and where they lie."""

    def __init__(self, table: pa.Table, names: Sequence[str], halo: int, size: int):
        self.grid = table["grid_id"][0].as_py()
        self.tr, self.tc = table["tr"][0].as_py(), table["tc"][0].as_py()
        self.halo, self.size = halo, size
        self.r0, self.c0 = self.tr * size - halo, self.tc * size - halo
        r, c = table["r"].to_numpy().astype(np.int64) - self.r0, table["c"].to_numpy().astype(np.int64) - self.c0
        wide = size + 2 * halo
        self.of: dict[str, np.ndarray] = {}
        for n in names:
            self.of[n] = np.full((wide, wide), np.nan)
            self.of[n][r, c] = table[n].to_numpy(zero_copy_only=False).astype(float)
        own = (r >= halo) & (r < halo + size) & (c >= halo) & (c < halo + size)
        self.at = r[own] - halo, c[own] - halo
        self.rows = len(self.at[0])

    def output(self, values: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.Table:
        """The tile's own cells with values[name][row, column] of the tile."""
        cells = {"grid_id": pa.array([self.grid] * self.rows, pa.string()), "r": pa.array(self.at[0] + self.tr * self.size, pa.int32()), "c": pa.array(self.at[1] + self.tc * self.size, pa.int32())}
        return pa.table(cells | {n: pa.array(v[self.at], kinds.get(n, pa.float64())) for n, v in values.items()})


def extents(pixels: DataFrame) -> DataFrame:
    """(grid_id, r_lo, r_hi, c_lo, c_hi): one row for each grid, the ends excluded above."""
    return pixels.groupBy("grid_id").agg(F.min("r").alias("r_lo"), (F.max("r") + 1).alias("r_hi"), F.min("c").alias("c_lo"), (F.max("c") + 1).alias("c_hi"))


def tile_apply(pixels: DataFrame, names: Sequence[str], halo: int, kernel: Callable[[Window, tuple[int, int, int, int]], dict[str, np.ndarray]], outputs: Sequence[str], size: int = SIZE) -> DataFrame:
    """(grid_id, r, c, outputs): kernel(window, extent of the grid) gives an array of the tile for each output."""
    schema = ", ".join(["grid_id string, r int, c int", *(f"{n} double" for n in outputs)])
    kept = list(outputs)

    def run(table):
        w = Window(table, names, halo, size)
        if not w.rows:  # a halo beside no cells of its own
            return pa.table({"grid_id": pa.array([], pa.string()), "r": pa.array([], pa.int32()), "c": pa.array([], pa.int32())} | {n: pa.array([], pa.float64()) for n in kept})
        extent = tuple(int(table[n][0].as_py()) for n in ("r_lo", "r_hi", "c_lo", "c_hi"))
        return w.output({n: v for n, v in kernel(w, extent).items() if n in kept}, {}).select(["grid_id", "r", "c", *kept])

    cells = spread(pixels.select("grid_id", "r", "c", *names), halo, size).join(extents(pixels), "grid_id")
    return cells.groupBy(*TILE).applyInArrow(run, schema)


def windows(pixels: DataFrame, names: Sequence[str], size: int = SIZE) -> DataFrame:
    """(grid_id, tr, tc, own, values by name): a row for each tile, its window with a halo of one cell as packed doubles."""

    def run(table):
        w = Window(table, names, 1, size)
        own = np.zeros((size, size), np.uint8)
        own[w.at] = 1
        row = {"grid_id": pa.array([w.grid], pa.string()), "tr": pa.array([w.tr], pa.int32()), "tc": pa.array([w.tc], pa.int32()), "own": pa.array([own.tobytes()], pa.binary())}
        return pa.table(row | {n: pa.array([w.of[n].tobytes()], pa.binary()) for n in names}).slice(0, int(w.rows > 0))

    schema = ", ".join(["grid_id string, tr int, tc int, own binary", *(f"{n} binary" for n in names)])
    return spread(pixels.select("grid_id", "r", "c", *names), 1, size).groupBy(*TILE).applyInArrow(run, schema)


def _shown(state: np.ndarray) -> bytes:
    """A tile's outermost cells: top and bottom row, left and right column."""
    return np.stack([state[0], state[-1], state[:, 0], state[:, -1]]).astype(float).tobytes()


def _around(rings, size: int, empty: float) -> np.ndarray:
    """A window whose outermost cells hold what the neighbours show; rings has (i, j, ring) of neighbours at (i, j)."""
    out = np.full((size + 2, size + 2), empty)
    for x in rings:
        i, j = x["i"], x["j"]
        top, bottom, left, right = np.frombuffer(x["ring"], float).reshape(4, size)
        if i and j:
            row = bottom if i < 0 else top
            out[0 if i < 0 else -1, 0 if j < 0 else -1] = row[-1 if j < 0 else 0]
        elif i:
            out[0 if i < 0 else -1, 1:-1] = bottom if i < 0 else top
        else:
            out[1:-1, 0 if j < 0 else -1] = right if j < 0 else left
    return out


def wave(tiles: DataFrame, names: Sequence[str], solve: Callable[[dict, np.ndarray, tuple], np.ndarray], empty: float, size: int, last: Callable[[dict, np.ndarray, np.ndarray, tuple], dict[str, np.ndarray]], outputs: dict[str, str]) -> DataFrame:
    """(grid_id, r, c, outputs) of tiles made by ``windows``, once no border changes.

    solve(values, around, place) gives the tile's state from its windows and the
    states around it (``empty`` where nothing is known yet; the result must not
    depend on the order of rounds); last(values, around, state, place) gives the
    outputs.  place is (first row, first column).
    """
    n = len(names)
    own = tiles.select(*TILE, "own", *names)

    def shared(rings: DataFrame) -> DataFrame:
        steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND)))
        return rings.select(*TILE, "ring", "changed", steps.alias("_s")).select("grid_id", (F.col("tr") - F.col("_s.i")).alias("tr"), (F.col("tc") - F.col("_s.j")).alias("tc"), F.struct(F.col("_s.i").alias("i"), F.col("_s.j").alias("j"), "ring").alias("near"), "changed")

    def gathered(rings: DataFrame) -> DataFrame:
        return shared(rings).groupBy(*TILE).agg(F.collect_list("near").alias("near"), F.max("changed").alias("touched"))

    def values(batch, i):
        wide = size + 2
        return {k: np.frombuffer(batch.column(4 + q)[i].as_buffer(), float).reshape(wide, wide) for q, k in enumerate(names)}, (batch.column(1)[i].as_py() * size, batch.column(2)[i].as_py() * size)

    def solved(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                of, place = values(batch, i)
                near, before = batch.column(4 + n)[i].as_py() or [], batch.column(5 + n)[i].as_py()
                ring = _shown(solve(of, _around(near, size, empty), place))
                old = before if before is not None else np.full((4, size), empty).tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([ring], pa.binary()), pa.array([ring != old])], names=[*TILE, "ring", "changed"])

    def finished(batches):
        kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
        for batch in batches:
            for i in range(batch.num_rows):
                of, place = values(batch, i)
                around = _around(batch.column(4 + n)[i].as_py() or [], size, empty)
                out = last(of, around, solve(of, around, place), place)
                at = np.nonzero(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(size, size))
                cells = [pa.array([batch.column(0)[i].as_py()] * len(at[0]), pa.string()), pa.array(at[0] + place[0], pa.int32()), pa.array(at[1] + place[1], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cells, *(pa.array(out[k][at], kinds[t]) for k, t in outputs.items())], names=["grid_id", "r", "c", *outputs])

    schema = "grid_id string, tr int, tc int, ring binary, changed boolean"
    none = own.withColumn("near", F.lit(None).cast("array<struct<i:int,j:int,ring:binary>>")).withColumn("ring", F.lit(None).cast("binary"))
    rings = settled(none.mapInArrow(solved, schema))
    while rings.where("changed").limit(1).count():
        active = gathered(rings).where("touched").drop("touched")
        again = own.join(active, TILE).join(rings.select(*TILE, "ring"), TILE).select(*none.columns).mapInArrow(solved, schema)
        done = settled(again)
        after = settled(done.unionByName(rings.join(done.select(*TILE), TILE, "left_anti").withColumn("changed", F.lit(False))))
        forgotten(rings, done)
        rings = after
    final = own.join(gathered(rings).drop("touched"), TILE, "left")
    return final.mapInArrow(finished, ", ".join(["grid_id string, r int, c int", *(f"{k} {t}" for k, t in outputs.items())]))
