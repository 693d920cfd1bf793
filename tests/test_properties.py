"""Property-based checks against plain-Python references (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replytime.functions.core import r_case
from replytime.operators import survival as S

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def km_python(rows):
    out = {}
    s = 1.0
    for t in sorted({t for t, _ in rows}):
        n = sum(1 for u, _ in rows if u >= t)
        d = sum(1 for u, e in rows if u == t and e == 1)
        s *= 1.0 - d / n
        out[t] = (n, d, s)
    return out


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 1)), min_size=1, max_size=40))
def test_km_equals_python(spark, rows):
    pairs = spark.createDataFrame([(float(t), e) for t, e in rows], "time double, event int")
    got = {r.time: (r.n_risk, r.n_event, r.surv) for r in S.kaplan_meier(pairs, conf=False).collect()}
    ref = km_python([(float(t), e) for t, e in rows])
    assert set(got) == set(ref)
    for t, (n, d, s) in ref.items():
        assert got[t][0] == n and got[t][1] == d and abs(got[t][2] - s) < 1e-12


def r_nested_ifelse(conds, vals, default):
    """Nested ifelse semantics: first NA condition gives NA; FALSE moves on."""
    for c, v in zip(conds, vals):
        if c is None:
            return None
        if c:
            return v
    return default


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([True, False, None]), st.sampled_from([True, False, None])),
                min_size=1, max_size=9))
def test_r_case_equals_nested_ifelse(spark, rows):
    df = spark.createDataFrame(rows, "c1 boolean, c2 boolean")
    expr = r_case((F.col("c1"), F.lit("a")), (F.col("c2"), F.lit("b")), default=F.lit("z"))
    got = [r.v for r in df.select(expr.alias("v")).collect()]
    assert got == [r_nested_ifelse([a, b], ["a", "b"], "z") for a, b in rows]


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 1)), min_size=1, max_size=30))
def test_piecewise_hazard_equals_python(spark, rows):
    pairs = spark.createDataFrame([(float(t), e) for t, e in rows], "time double, event int")
    got = {r.bin_start: (r.events, r.person_time) for r in S.hazard_piecewise(pairs, 1.0, 10.0).collect()}
    ref = {}
    for b in range(10):
        pt = sum(min(t, b + 1) - b for t, _ in rows if t > b)
        ev = sum(1 for t, e in rows if e == 1 and b < t <= b + 1)
        if pt > 0:
            ref[float(b)] = (ev, float(pt))
    assert got == ref


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy")), min_size=1, max_size=40))
def test_cross_table_margins_sum_to_one(spark, rows):
    from replytime.operators.describe import cross_table
    df = spark.createDataFrame(rows, "a string, b string")
    out = cross_table(df, "a", "b").collect()
    for key, col in (("a", "prop_row"), ("b", "prop_col")):
        sums = {}
        for r in out:
            sums[r[key]] = sums.get(r[key], 0.0) + r[col]
        assert all(abs(v - 1.0) < 1e-12 for v in sums.values())
    assert abs(sum(r.prop_total for r in out) - 1.0) < 1e-12
    assert sum(r.n for r in out) == len(rows)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 1200), st.integers(0, 1)), min_size=1, max_size=30))
def test_piecewise_hazard_fractional_times(spark, rows):
    rows = [(t / 100.0, e) for t, e in rows]  # times in (0, 12], off the bin edges too
    pairs = spark.createDataFrame(rows, "time double, event int")
    got = {r.bin_start: (r.events, r.person_time) for r in S.hazard_piecewise(pairs, 1.0, 10.0).collect()}
    ref = {}
    for b in range(10):
        pt = sum(min(t, b + 1) - b for t, _ in rows if t > b)
        ev = sum(1 for t, e in rows if e == 1 and b < t <= b + 1)
        if pt > 0:
            ref[float(b)] = (ev, pt)
    assert set(got) == set(ref)
    for k in ref:
        assert got[k][0] == ref[k][0] and abs(got[k][1] - ref[k][1]) < 1e-9
