"""Distributed quantiles and running sums against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.operators import prefix, quantiles


@pytest.mark.parametrize("enough, accuracy", [(50_000, 10_000), (40, 50), (40, 10_000)])
def test_quantiles_equal_percentile(spark, enough, accuracy):
    rng = np.random.default_rng(4)
    n = 3000
    rows = [(k % 3 if k % 7 else None, float(rng.normal()), int(rng.integers(0, 5)), None if rng.random() < .3 else float(rng.exponential()))
            for k in range(n)]
    df = spark.createDataFrame(rows, "g int, a double, b int, c double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for by in ((), ("g",)):
        got = {(*[r[k] for k in by], r.variable, r.p): r.value
               for r in quantiles.exact_quantiles(df, ["a", "b", "c"], probs, by, enough, accuracy).collect()}
        want = {}
        for r in df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in "abc"]).collect():
            want |= {(*[r[k] for k in by], c, p): v for c in "abc" for p, v in zip(probs, r[c])}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_quantiles_edges(spark):
    schema = "g int, x double"
    assert quantiles.exact_quantiles(spark.createDataFrame([], schema), ["x"], [0.5]).count() == 0
    df = spark.createDataFrame([(1, None), (1, float("nan")), (2, 7.0)], schema)
    assert [tuple(r) for r in quantiles.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()] == [(2, "x", 0.5, 7.0)]
    assert quantiles.few_values(df, ["x"]) and not quantiles.few_values(spark.range(5000), ["id"], few=1000)


def test_quantiles_of_many_values_hold_no_task(spark):
    df = spark.range(1_000_000).select(F.hash("id").cast("double").alias("x"))
    got = {r.p: r.value for r in quantiles.exact_quantiles(df, ["x"], [0.25, 0.5], enough=2000).collect()}
    want = df.agg(F.percentile("x", [0.25, 0.5]).alias("q")).first().q
    assert [got[0.25], got[0.5]] == want


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_sums(spark, monkeypatch, descending, by):
    monkeypatch.setattr(prefix, "RUN", 3)
    rows = [(k % 2 if k % 11 else None, k * 7919 % 1009, k % 13) for k in range(1009)]
    df = prefix.in_blocks(spark.createDataFrame(rows, "g int, t int, v long"), "t", by, blocks=17)
    assert df.select(prefix.BLOCK).distinct().count() > 10
    got = prefix.running(df, {"s": "v", "n": F.lit(1)}, "t", by, descending)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert prefix.BLOCK in plan
    for r in got.collect():
        same = [x for x in rows if (not by or x[0] == r.g) and (x[1] >= r.t if descending else x[1] <= r.t)]
        assert (r.s, r.n) == (sum(x[2] for x in same), len(same))


def test_survival_in_blocks_equals_one_window(spark):
    from replytime.models import cox as CX
    from replytime.models.design import Numeric
    from replytime.operators import survival as S
    rng = np.random.default_rng(8)
    rows = [(float(np.round(rng.exponential(), 2)) + 0.01, int(rng.random() < .7), float(rng.normal()), k % 7, "ab"[k % 2])
            for k in range(800)]
    df = spark.createDataFrame(rows, "time double, event int, x double, c int, g string")
    for by in ((), ("g",)):
        want = {(*[r[k] for k in by], r.time): r for r in S.kaplan_meier(df, by=by).collect()}
        got = S.kaplan_meier(df, by=by, many=0).collect()
        assert len(got) == len(want)
        for r in got:
            w = want[(*[r[k] for k in by], r.time)]
            assert (r.n_risk, r.n_event, r.n_censor) == (w.n_risk, w.n_event, w.n_censor)
            assert np.allclose([r.surv, r.std_err or 0], [w.surv, w.std_err or 0], atol=1e-12)
        assert {tuple(r) for r in S.risk_table(df, by=by, many=0).collect()} == {tuple(r) for r in S.risk_table(df, by=by).collect()}
    a, b = (CX.fit_cox(df, "time", "event", [Numeric("x")], cluster="c", many=m) for m in (prefix.MANY, 0))
    assert np.allclose(a.beta, b.beta, atol=1e-9) and np.allclose(a.cov, b.cov) and np.allclose(a.robust_cov, b.robust_cov)
    for kind in ("km", "rank", "identity"):
        x, y = ([tuple(r)[1:] for r in CX.schoenfeld_test(df, f, "time", "event", spark, kind).collect()] for f in (a, b))
        assert np.allclose(np.array(x, float), np.array(y, float), equal_nan=True, rtol=1e-6)
    h = [{r.time: r.cumhaz for r in CX.baseline_hazard(df, f, "time", "event").collect()} for f in (a, b)]
    assert h[0].keys() == h[1].keys() and all(abs(h[0][t] - h[1][t]) < 1e-9 for t in h[0])
