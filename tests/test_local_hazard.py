"""Hazard with local bandwidths against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.operators import survival as S


def weight(g, t, b, lo, hi):
    x, ql, qr = (g - t) / b, (g - lo) / b, (hi - g) / b

    def edge(x, q):
        return 12 / (1 + q) ** 4 * (x + 1) * (x * (1 - 2 * q) + (3 * q * q - 2 * q + 1) / 2)

    if abs(x) > 1:
        return 0.0
    if ql < 1:
        return edge(x, ql) if x <= ql else 0.0
    if qr < 1:
        return edge(-x, qr) if -x <= qr else 0.0
    return 0.75 * (1 - x * x)


def plain(time, event, pilot, widths, smooth, lo, hi, n):
    grid = lo + np.arange(n) * (hi - lo) / (n - 1)
    step = grid[1] - grid[0]
    times = np.unique(time[event == 1])
    dh = np.array([((time == t) & (event == 1)).sum() / (time >= t).sum() for t in times])
    h0 = np.array([sum(weight(g, t, pilot, lo, hi) * d for t, d in zip(times, dh)) / pilot for g in grid])
    risk = np.array([(time >= g - 1e-9 * step).sum() for g in grid])
    best = []
    for i, g in enumerate(grid):
        errors = []
        for b in widths:
            k = np.array([weight(g, u, b, lo, hi) for u in grid])
            bias = k @ h0 / k.sum() - h0[i]
            noise = np.where(risk > 0, h0 / (np.maximum(risk, 1) * step), 0.0)
            errors.append((round(bias ** 2 + (k * k) @ noise / k.sum() ** 2, 12), b))
        best.append(min(errors)[1])
    best, out = np.array(best), []
    for g in grid:
        w = np.maximum(0.0, 1 - ((grid - g) / smooth) ** 2)
        b = w @ best / w.sum()
        out.append((g, b, sum(weight(g, t, b, lo, hi) * d for t, d in zip(times, dh)) / b))
    return best, np.array(out)


@pytest.mark.parametrize("whole", [True, False])
def test_equals_plain_numpy(spark, whole):
    rng = np.random.default_rng(7)
    time = np.concatenate([rng.exponential(6, 250), 25 + rng.exponential(3, 150), rng.uniform(0, 45, 60)])
    time = np.ceil(time) if whole else time
    event = (rng.uniform(size=len(time)) < 0.8).astype(int)
    rows = spark.createDataFrame([(g, float(t), int(e)) for g in ("a", "b") for t, e in zip(time if g == "a" else time / 2, event)],
                                 "g string, time double, event int")
    widths, args = [2.0, 3.0, 4.5, 6.0, 9.0], dict(min_time=0.0, max_time=40.0, n_grid=33)
    got = S.hazard_kernel_local(rows, 4.0, widths, 8.0, by=("g",), **args)
    chosen = S.local_bandwidths(rows, 4.0, widths, by=("g",), **args)
    for g, t in (("a", time), ("b", time / 2)):
        best, want = plain(t, event, 4.0, widths, 8.0, 0.0, 40.0, 33)
        have = [r.bandwidth for r in chosen.where(F.col("g") == g).orderBy("j").collect()]
        assert have == best.tolist() and len(set(have)) > 1
        rows_of = np.array([(r.time, r.bandwidth, r.hazard) for r in got.where(F.col("g") == g).orderBy("time").collect()])
        assert np.allclose(rows_of, want, atol=1e-10)


def test_one_bandwidth_is_the_global_estimate(spark):
    rows = spark.createDataFrame([(float(1 + i % 30), 1) for i in range(300)], "time double, event int")
    a = S.hazard_kernel_local(rows, 5.0, [5.0], max_time=28.0, n_grid=29).orderBy("time").collect()
    b = S.hazard_kernel(rows, 5.0, max_time=28.0, n_grid=29).orderBy("time").collect()
    assert np.allclose([r.hazard for r in a], [r.hazard for r in b]) and {round(r.bandwidth, 9) for r in a} == {5.0}


def test_edges(spark):
    rows = spark.createDataFrame([], "time double, event int")
    assert {r.hazard for r in S.hazard_kernel_local(rows, 5.0, [3.0, 5.0]).collect()} == {0.0}
    for bad in ([], [0.0], [0.1]):
        with pytest.raises(ValueError, match="bandwidths"):
            S.hazard_kernel_local(rows, 5.0, bad)
