"""Kaplan-Meier and hazards against hand computation and properties."""

import math

from pyspark.sql import functions as F

from replytime.operators import survival as S

from .conftest import SF001


def test_km_by_hand(spark):
    # times with ties, a censoring, last row an event
    rows = [(1.0, 1), (2.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1)]
    pairs = spark.createDataFrame(rows, "time double, event int")
    km = {r.time: r for r in S.kaplan_meier(pairs).collect()}
    s1 = 1 - 1 / 6
    s2 = s1 * (1 - 2 / 5)
    assert abs(km[1.0].surv - s1) < 1e-12 and km[1.0].n_risk == 6
    assert abs(km[2.0].surv - s2) < 1e-12 and km[2.0].n_risk == 5 and km[2.0].n_censor == 1
    assert abs(km[3.0].surv - s2) < 1e-12 and km[3.0].n_risk == 2
    assert km[4.0].surv == 0.0 and km[4.0].lower is None
    gw = 1 / (6 * 5) + 2 / (5 * 3)
    assert abs(km[2.0].std_err - s2 * math.sqrt(gw)) < 1e-12


def test_km_all_censored_and_single(spark):
    pairs = spark.createDataFrame([(5.0, 0), (7.0, 0)], "time double, event int")
    assert {r.surv for r in S.kaplan_meier(pairs).collect()} == {1.0}
    one = spark.createDataFrame([(3.0, 1)], "time double, event int")
    assert S.kaplan_meier(one).first().surv == 0.0


def test_km_without_censoring_is_one_minus_ecdf(spark, derived001):
    pairs = S.survival_pair(derived001, "reply_time1", "event")
    km = S.kaplan_meier(pairs).orderBy("time").collect()
    n = sum(r.n_event + r.n_censor for r in km)
    cum = 0
    prev = 1.0
    for r in km:
        cum += r.n_event
        assert abs(r.surv - (1 - cum / n)) < 1e-9
        assert r.surv <= prev + 1e-15
        prev = r.surv


def test_km_partitioning_invariant(spark, derived001):
    pairs = S.survival_pair(derived001.where(F.col("overall_tri").isNotNull()), "reply_time", "event",
                            by=("overall_tri",))
    a = sorted((r.overall_tri, r.time, round(r.surv, 12)) for r in
               S.kaplan_meier(pairs, by=("overall_tri",)).collect())
    b = sorted((r.overall_tri, r.time, round(r.surv, 12)) for r in
               S.kaplan_meier(pairs.repartition(13), by=("overall_tri",)).collect())
    assert a == b


def test_window_runs_after_aggregation(spark, derived001):
    """The KM window sits above a hash aggregate (never on raw rows)."""
    pairs = S.survival_pair(derived001, "reply_time", "event")
    plan = S.kaplan_meier(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.find("Window") < plan.find("HashAggregate")  # window is above (printed first)


def test_piecewise_hazard_by_hand(spark):
    pairs = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1)], "time double, event int")
    out = {r.bin_start: r for r in S.hazard_piecewise(pairs, 1.0, 3.0).collect()}
    # bin (0,1]: 4 at risk a full day, 1 event
    assert out[0.0].person_time == 4.0 and out[0.0].events == 1
    # bin (1,2]: 3 at risk, 2 leave at t = 2 (one event)
    assert out[1.0].person_time == 3.0 and out[1.0].events == 1
    assert out[2.0].person_time == 1.0 and out[2.0].events == 1


def test_kernel_hazard_positive_and_complete(spark, derived001):
    pairs = S.survival_pair(derived001, "reply_time", "event")
    rows = S.hazard_kernel(pairs, 5.0, 0.0, 70.0, 101).collect()
    assert len(rows) == 101
    assert all(r.hazard >= -1e-12 for r in rows if r.time >= 5 and r.time <= 65)


def test_sf_fixture_km_rows(spark):
    from replytime.plans.common import derived
    d = derived(spark, SF001)
    pairs = S.survival_pair(d.withColumn("g", F.coalesce("q74", F.lit("NA"))), "reply_time", "event", by=("g",))
    assert S.kaplan_meier(pairs, by=("g",)).count() == 446


def test_curve_alignment_pivot_equals_full_joins(spark, derived001):
    pairs = S.stack_curves(derived001, {"all": "reply_time", "mail1": "reply_time1", "mail2": "reply_time2"})
    km = S.response_curve(S.kaplan_meier(pairs, by=("curve",), conf=False))
    names = {"all": "r0", "mail1": "r1", "mail2": "r2"}
    a = S.align_curves_long(km, names)
    b = S.align_curves({v: km.where(F.col("curve") == k) for k, v in names.items()})
    key = lambda r: r.time
    ra = sorted(a.collect(), key=key)
    rb = sorted(b.select("time", "r0", "r1", "r2").collect(), key=key)
    assert ra == rb


def test_derived_table_shuffles_no_rows(spark):
    """The derived wave is one projection over one scan; its two global facts are literals
    (or, without them, a censoring subquery: a one-row aggregate)."""
    import contextlib
    import io
    from replytime.operators.derive import derive_wave
    from replytime.plans.common import derived, raw
    from .conftest import SF0001
    for df, alone in ((derived(spark, SF0001), True), (derive_wave(raw(spark, SF0001)), False)):
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        main, _, subqueries = buf.getvalue().partition("===== Subqueries =====")
        assert "Exchange" not in main
        assert ("Exchange" in subqueries) != alone


def test_km_conf_types_and_events_only(spark):
    rows = [(1.0, 1), (2.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1)]
    pairs = spark.createDataFrame(rows, "time double, event int")
    s2 = (1 - 1 / 6) * (1 - 2 / 5)
    gw = 1 / (6 * 5) + 2 / (5 * 3)
    z = S.Z975
    plain = {r.time: r for r in S.kaplan_meier(pairs, conf_type="plain").collect()}
    assert abs(plain[2.0].lower - (s2 - z * s2 * math.sqrt(gw))) < 1e-12
    loglog = {r.time: r for r in S.kaplan_meier(pairs, conf_type="log-log").collect()}
    w = z * math.sqrt(gw) / abs(math.log(s2))
    assert abs(loglog[2.0].lower - math.exp(-math.exp(math.log(-math.log(s2)) + w))) < 1e-12
    assert abs(loglog[2.0].upper - math.exp(-math.exp(math.log(-math.log(s2)) - w))) < 1e-12
    ev = sorted(r.time for r in S.kaplan_meier(pairs, events_only=True).collect())
    assert ev == [1.0, 2.0, 4.0]
