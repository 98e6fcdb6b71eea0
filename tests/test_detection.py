"""Edges, lines, drainage flags, paths and scores on inputs whose answer is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesta.operators import detection, edges, evaluation, hydrology, kernels, scoring, tracing


def grid(spark, z):
    rows = [("g0", r, c, float(v)) for (r, c), v in np.ndenumerate(np.asarray(z, dtype=float))]
    return spark.createDataFrame(rows, "grid_id string, r int, c int, z double")


def mask(spark, cells):
    return spark.createDataFrame([("g0", r, c) for r, c in cells], "grid_id string, r int, c int")


def lines(spark, named):
    rows = [(k, s, float(x), float(y)) for k, pts in named.items() for s, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "trace_id string, seq int, x double, y double")


def test_canny_finds_a_step_and_nothing_on_flat_ground(spark):
    z = np.zeros((20, 20))
    z[:, 10:] = 1
    found = {(x.r, x.c) for x in edges.canny(grid(spark, z)).collect()}
    assert found and all(c in (9, 10) for _, c in found)
    assert {r for r, _ in found} == set(range(20))
    assert edges.canny(grid(spark, np.ones((8, 8)))).count() == 0
    with pytest.raises(ValueError):
        edges.canny(grid(spark, z), low=0.9, high=0.5)


def test_hysteresis_keeps_weak_cells_of_strong_components(spark):
    cells = spark.createDataFrame([("g0", 0, 0, 5.0), ("g0", 0, 1, 2.0), ("g0", 1, 2, 2.0), ("g0", 5, 5, 2.0), ("g0", 9, 9, 1.0)], "grid_id string, r int, c int, nms double")
    found = {(x.r, x.c) for x in edges.hysteresis(cells, F.lit(2.0), F.lit(5.0)).collect()}
    assert found == {(0, 0), (0, 1), (1, 2)}


def test_tensor_responses(spark):
    z = np.zeros((30, 30))
    z[:, 15:] = 1
    t = kernels.structure_tensor(grid(spark, z), ["z"])
    at = t.where("r = 15 AND c = 15").select("l1", "l2", *(edges.tensor_response(t, k).alias(k) for k in ("anisotropy", "coherence", "lambda1"))).first()
    assert at.anisotropy == pytest.approx(at.l1 - at.l2) and at.lambda1 == at.l1
    assert at.coherence == pytest.approx((at.l1 - at.l2) / (at.l1 + at.l2), rel=1e-6) and at.coherence > 0.99
    with pytest.raises(ValueError):
        edges.tensor_response(t, "other")


def test_detector_registry():
    assert "classical" in edges.available_detectors() and edges.available_detectors() == sorted(edges.available_detectors())
    with pytest.raises(ValueError):
        edges.register_detector("classical", edges.classical)
    with pytest.raises(ValueError):
        edges.register_detector("", edges.classical)
    with pytest.raises(KeyError):
        edges.get_detector("none")


def test_chains_split_at_junctions_and_close_loops(spark):
    cross = [(5, c) for c in range(11)] + [(r, 5) for r in range(11) if r != 5]
    found = tracing.trace_skeleton(mask(spark, cross)).groupBy("chain").count().collect()
    assert len(found) >= 4
    loop = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    rows = tracing.trace_skeleton(mask(spark, loop)).orderBy("seq").collect()
    cells = [(x.r, x.c) for x in rows]
    assert cells[:2] == cells[-2:] and len(cells) == 10  # a loop runs on to its second cell


def test_a_ring_may_end_where_it_began(spark):
    ring = [(37, 33), (38, 32), (39, 33), (38, 34)]
    rows = tracing.trace_skeleton(mask(spark, ring), overlap=False).orderBy("seq").collect()
    assert [(x.r, x.c) for x in rows] == [*ring, ring[0]] and {x.n for x in rows} == {5}
    line = [(0, c) for c in range(4)]
    assert tracing.trace_skeleton(mask(spark, line), overlap=False).count() == 4


def test_polylines_drop_short_chains_and_simplify(spark):
    cells = [(3, c) for c in range(12)] + [(9, 1), (9, 2)]
    rows = tracing.polylines_from_mask(mask(spark, cells), 5, 1.0).orderBy("seq").collect()
    assert [(x.x, x.y) for x in rows] == [(0.0, 3.0), (11.0, 3.0)]


@pytest.mark.parametrize(
    ("named", "n"),
    [
        ({"a": [(0, 0), (10, 0)], "b": [(13, 0), (23, 0)]}, 1),  # in line
        ({"a": [(0, 0), (10, 0)], "b": [(11, 3), (21, 3)]}, 2),  # beside
        ({"a": [(0, 0), (10, 0)], "b": [(11, 1), (11, 11)]}, 2),  # a corner
        ({"a": [(0, 0), (10, 0)], "b": [(30, 0), (40, 0)]}, 2),  # far
        ({"a": [(0, 0), (10, 0)], "b": [(23, 0), (13, 0)], "c": [(26, 0), (36, 0)]}, 1),  # a chain, one reversed
        ({"a": [(0, 0), (10, 0)], "b": [(10, 0), (20, 0)]}, 1),  # touching
    ],
)
def test_linking(spark, named, n):
    out = tracing.link_polylines(lines(spark, named)).collect()
    assert len({x.trace_id for x in out}) == n
    if n == 1:
        xs = [x.x for x in sorted(out, key=lambda x: x.seq)]
        assert xs == sorted(xs) or xs == sorted(xs, reverse=True)
        assert len(xs) == len(set(xs))


def test_a_creek_is_flagged_and_a_crossing_is_not(spark):
    r, c = np.mgrid[0:40, 0:21]
    valley = grid(spark, np.abs(c - 10) + 0.2 * (39 - r))
    t = lines(spark, {"creek": [(10, 2), (10, 37)], "across": [(1, 20), (19, 20)]})
    got = {x.trace_id: x for x in hydrology.flag_drainage(t, valley, 40, 21, downsample=1, least=15).collect()}
    assert got["creek"].is_drainage and got["creek"].aligned > 0.9 and got["creek"].monotonicity == pytest.approx(1)
    assert not got["across"].is_drainage and got["across"].rank > got["creek"].rank


def test_path_follows_the_cheap_channel(spark):
    cost = np.full((20, 20), 10.0)
    cost[5, :] = 0.1
    cost[5:, 15] = 0.1
    got = [(x.r, x.c) for x in tracing.least_cost_path(grid(spark, cost).withColumnRenamed("z", "cost"), (5, 0), (19, 15)).orderBy("seq").collect()]
    assert got[0] == (5, 0) and got[-1] == (19, 15)
    assert sum(cost[p] > 1 for p in got) == 0


def test_path_cost_equals_relaxation(spark):
    rng = np.random.default_rng(3)
    cost = rng.uniform(0.1, 2, (9, 11))
    dist = np.full(cost.shape, np.inf)
    dist[4, 4] = 0
    for _ in range(cost.size):
        for (r, c), _ in np.ndenumerate(cost):
            for i, j in kernels.SQUARE:
                a, b = r + i, c + j
                if 0 <= a < 9 and 0 <= b < 11:
                    dist[a, b] = min(dist[a, b], dist[r, c] + (cost[r, c] + cost[a, b]) / 2 * np.hypot(i, j))
    got = kernels.cost_to_all(grid(spark, cost).withColumnRenamed("z", "cost"), (4, 4)).collect()
    assert all(x.distance == pytest.approx(dist[x.r, x.c]) for x in got)


def test_nothing_on_flat_ground(spark):
    found, _ = detection.detect_traces(grid(spark, np.ones((12, 12))), (0.0, 10.0, 0.0, 120.0, 0.0, -10.0), 12, 12, res=10.0)
    assert found.count() == 0


def test_an_escarpment_gives_a_trace(spark):
    from cuesta.operators import stencils
    from cuesta.operators.fixpoint import settled

    r, c = np.mgrid[0:120, 0:120]
    scarp = grid(spark, (119 - r) * 15.0 + 200 / (1 + np.exp(-(c - r) / 2.0)))
    stack = settled(stencils.terrain_stack(scarp, 30.0, list(detection.BANDS)))
    assert edges.classical(stack, list(detection.BANDS), min_length=8).count() > 0


def test_scores_over_many_partitions(spark):
    n = 300_000
    rows = spark.range(n).select((F.xxhash64("id") % 2 == 0).cast("int").alias("pos"), (F.xxhash64("id", F.lit(7)) % 1_000_003).cast("double").alias("v"))
    both = rows.toPandas()
    p, q = np.sort(both.v[both.pos == 1].to_numpy()), np.sort(both.v[both.pos == 0].to_numpy())
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            a, y = scoring.auc(rows).first(), scoring.youden(rows).first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert (a.positives, a.negatives) == (len(p), len(q))
        assert a.auc == pytest.approx(np.searchsorted(q, p, "right").sum() / (len(p) * len(q)), abs=1e-12)
        u = np.unique(both.v)
        cut = (u[1:] + u[:-1]) / 2
        j = (len(p) - np.searchsorted(p, cut)) / len(p) - (len(q) - np.searchsorted(q, cut)) / len(q)
        assert y.j == pytest.approx(j.max(), abs=1e-12) and y.threshold == pytest.approx(cut[j.argmax()])


def test_scores_of_one_class_are_nan(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "pos int, v double")
    assert np.isnan(scoring.youden(one).first().j) and scoring.auc(one).first().auc is None


def test_windows_do_not_overlap(spark):
    cells = [(r, c) for r in range(3, 6) for c in range(3, 6)] + [(20, 20), (20, 21)]
    got = evaluation.densest_windows(mask(spark, cells), grid(spark, np.zeros((30, 30))), 4, 2)
    (r1, c1, d1), (r2, c2, d2) = got
    assert d1 >= d2 > 0 and not (r1 - 4 <= r2 < r1 + 4 and c1 - 4 <= c2 < c1 + 4)


def test_flags_read_the_tables_once(spark):
    """The plan of the flags holds stored inputs: the derivation of grid and traces is not compiled into each of its stages."""
    from cuesta.plans import catalog

    out = catalog.queries()["h12_flags"](spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "testdata" in f]
