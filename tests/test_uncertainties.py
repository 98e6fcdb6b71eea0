"""Monte Carlo uncertainties against planes fitted by singular values to each perturbed trace."""

import numpy as np
import pytest

from cuesta.operators import attitude


def by_singular_values(points, sigma, n_mc, seed, length):
    rng = np.random.default_rng(seed)
    z = rng.normal(0.0, sigma, (n_mc, len(points)))
    tilts = rng.normal(0.0, sigma / length, (n_mc, 2)) if length and length > 0 else np.zeros((n_mc, 2))
    dips, directions = [], []
    for noise, tilt in zip(z, tilts, strict=True):
        p = points.copy()
        p[:, 2] += noise + (points[:, :2] - points[:, :2].mean(axis=0)) @ tilt
        n = np.linalg.svd(p - p.mean(axis=0))[2][2]
        n = -n if n[2] < 0 else n
        dips.append(np.degrees(np.arccos(n[2])))
        directions.append(np.arctan2(n[0], n[1]))
    r = np.hypot(np.mean(np.sin(directions)), np.mean(np.cos(directions)))
    return np.std(dips), np.degrees(np.sqrt(-2 * np.log(r)))


def trace(n):
    rng = np.random.default_rng(n)
    t = np.linspace(0, 1, n)
    x, y = 3000 * t + rng.normal(0, 60, n), 700 * np.sin(4 * t)
    return np.column_stack([x + 5e5, y + 4e6, 900 + 0.3 * x - 0.2 * y])


@pytest.mark.parametrize("length", [500.0, None, 0.0, -1.0])
@pytest.mark.parametrize("n", [3, 20, 150])
def test_equal_to_singular_values(n, length):
    got = attitude.monte_carlo(trace(n), 2.0, 60, 7, length)
    assert got == pytest.approx(by_singular_values(trace(n), 2.0, 60, 7, length), abs=1e-7)


def test_order_of_rows_and_short_traces(spark):
    points = trace(30)
    rows = [(1, i // 10, i % 10, *map(float, p)) for i, p in enumerate(points)][::-1] + [(2, 0, 0, 1.0, 2.0, 3.0), (2, 0, 1, 2.0, 2.0, 3.0)]
    samples = spark.createDataFrame(rows, "trace_id long, seq int, k int, x double, y double, z double")
    out = {r.trace_id: r[1:] for r in attitude.uncertainties(samples).collect()}
    assert out[1] == pytest.approx(attitude.monte_carlo(points, 2.0), abs=1e-9)
    assert np.isnan(out[2]).all()
    for size in ("7", "1000"):  # traces that span batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            many = samples.union(samples.where("trace_id = 1").withColumn("trace_id", samples.trace_id + 4)).union(samples.where("trace_id = 1 AND seq < 2").withColumn("trace_id", samples.trace_id + 2))
            again = {r.trace_id: r[1:] for r in attitude.uncertainties(many).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(again) == {1, 2, 3, 5} and again[1] == again[5] == pytest.approx(out[1], abs=1e-12)
        assert again[3] == pytest.approx(attitude.monte_carlo(points[:20], 2.0), abs=1e-9)
    assert not attitude.uncertainties(samples.where("false")).collect()


def test_noise_drawn_in_blocks_is_the_same(monkeypatch):
    whole = attitude.monte_carlo(trace(40), 2.0, 60, 7)
    monkeypatch.setattr(attitude._Noise, "LARGEST", 500)
    assert attitude.monte_carlo(trace(40), 2.0, 60, 7) == pytest.approx(whole, abs=1e-12)
