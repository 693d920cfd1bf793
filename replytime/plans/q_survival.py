"""Survival-curve queries (section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import survival as S
from ..operators.derive import derive_wave
from .common import FINE_SQL, all_waves, derived, fine_times
from .oracle_base import km_sql, with_derived, with_waves
from .registry import query, rounded

_KM_COLS = "time, n_risk, n_event, n_censor, round(surv, 8) AS surv"
_KM_CONF = ("round(surv * sqrt(gw), 8) AS std_err, "
            "round(CASE WHEN z = 0 THEN exp(lns - 1.959963984540054 * sqrt(gw)) END, 8) AS lower, "
            "round(CASE WHEN z = 0 THEN least(1.0, exp(lns + 1.959963984540054 * sqrt(gw))) END, 8) AS upper")


@query("km_by_group", sql=with_derived(
    f"SELECT overall_tri, {_KM_COLS}, {_KM_CONF} FROM km",
    """km_in AS (SELECT overall_tri, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL AND overall_tri IS NOT NULL),"""
    + km_sql("km_in", "overall_tri")))
def km_by_group(spark, sf_dir):
    """Kaplan-Meier of reply time by satisfaction, Greenwood error, log-scale limits."""
    d = derived(spark, sf_dir).where(F.col("overall_tri").isNotNull())
    pairs = S.survival_pair(d, "reply_time", "event", by=("overall_tri",))
    return rounded(S.kaplan_meier(pairs, by=("overall_tri",)), 8)


_CURVES = {"all": "reply_time", "mail1": "reply_time1", "mail2": "reply_time2", "mail3": "reply_time3"}
_CURVES_SQL = """curves_in AS (
  SELECT 'all' AS curve, record, CAST(reply_time AS DOUBLE) AS time, event FROM d WHERE reply_time IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail1', record, CAST(reply_time1 AS DOUBLE), event FROM d WHERE reply_time1 IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail2', record, CAST(reply_time2 AS DOUBLE), event FROM d WHERE reply_time2 IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail3', record, CAST(reply_time3 AS DOUBLE), event FROM d WHERE reply_time3 IS NOT NULL AND event IS NOT NULL
)"""


@query("survival_pair", sql=with_derived("SELECT curve, record, time, event FROM curves_in", _CURVES_SQL))
def survival_pair(spark, sf_dir):
    """(time, event) pairs for all replies and for each mailing, long form."""
    return S.stack_curves(derived(spark, sf_dir), _CURVES, by=("record",))


@query("km_overall", sql=with_derived(f"SELECT curve, {_KM_COLS}, {_KM_CONF} FROM km",
                                      _CURVES_SQL + "," + km_sql("curves_in", "curve")))
def km_overall(spark, sf_dir):
    """Kaplan-Meier without covariates: all replies and each mailing (one pass, four curves).

    The per-mailing times carry no censored rows, so those curves are 1 - ECDF.
    """
    pairs = S.stack_curves(derived(spark, sf_dir), _CURVES)
    return rounded(S.kaplan_meier(pairs, by=("curve",)), 8)


_FINE_IN = (f"fine_in AS (SELECT time, event FROM (SELECT {FINE_SQL} AS time, event FROM d) f "
            "WHERE time IS NOT NULL AND event IS NOT NULL)")


@query("km_continuous", sql=with_derived(
    f"SELECT round(time, 8) AS time, n_risk, n_event, n_censor, round(surv, 8) AS surv, {_KM_CONF} FROM km",
    _FINE_IN + "," + km_sql("fine_in")))
def km_continuous(spark, sf_dir):
    """Kaplan-Meier on a finely divided reply time: running sums in blocks of the time axis, no window over all times."""
    pairs = S.survival_pair(fine_times(derived(spark, sf_dir)), "fine_time", "event")
    return rounded(S.kaplan_meier(pairs, many=0), 8)


@query("km_by_trust", sql=with_derived(
    f"SELECT trustcode, {_KM_COLS} FROM km",
    """km_in AS (SELECT trustcode, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL),""" + km_sql("km_in", "trustcode")))
def km_by_trust(spark, sf_dir):
    """One response curve per trust: a window partitioned by trust, no loop."""
    pairs = S.survival_pair(derived(spark, sf_dir), "reply_time", "event", by=("trustcode",))
    return rounded(S.kaplan_meier(pairs, by=("trustcode",), conf=False), 8)


@query("response_curve", sql=with_derived(
    "SELECT overall_tri, time, round(1.0 - surv, 8) AS response_rate FROM km",
    """km_in AS (SELECT overall_tri, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL AND overall_tri IS NOT NULL),"""
    + km_sql("km_in", "overall_tri")))
def response_curve(spark, sf_dir):
    """Cumulative response rate 1 - S(t) by satisfaction."""
    d = derived(spark, sf_dir).where(F.col("overall_tri").isNotNull())
    km = S.kaplan_meier(S.survival_pair(d, "reply_time", "event", by=("overall_tri",)), by=("overall_tri",),
                        conf=False)
    return rounded(S.response_curve(km).select("overall_tri", "time", "response_rate"), 8)


@query("loglogistic_check", sql=with_derived(
    "SELECT overall_tri, time, round(CASE WHEN surv > 0 AND surv < 1 AND time > 0 THEN ln(time) END, 8) AS log_time, "
    "round(CASE WHEN surv > 0 AND surv < 1 AND time > 0 THEN ln((1.0 - surv) / surv) END, 8) AS log_odds_response FROM km",
    """km_in AS (SELECT overall_tri, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL AND overall_tri IS NOT NULL),"""
    + km_sql("km_in", "overall_tri")))
def loglogistic_check(spark, sf_dir):
    """log((1-S)/S) against log t per satisfaction group (straight lines: log-logistic)."""
    d = derived(spark, sf_dir).where(F.col("overall_tri").isNotNull())
    km = S.kaplan_meier(S.survival_pair(d, "reply_time", "event", by=("overall_tri",)), by=("overall_tri",),
                        conf=False)
    return rounded(S.loglogistic_check(km, by=("overall_tri",)), 8)


_BW, _GRID_N, _TMAX = 5.0, 101, 70.0
_STEP = _TMAX / (_GRID_N - 1)


def _bk(x: str, q: str) -> str:
    return f"(12.0 / pow(1.0 + {q}, 4)) * ({x} + 1.0) * ({x} * (1.0 - 2.0 * {q}) + (3.0 * {q} * {q} - 2.0 * {q} + 1.0) / 2.0)"


_HK_BODY = f"""
SELECT g.t AS time, round(coalesce(sum(CASE
    WHEN abs((g.t - i.time) / {_BW}) > 1 THEN 0.0
    WHEN g.t / {_BW} < 1 THEN CASE WHEN (g.t - i.time) / {_BW} <= g.t / {_BW}
         THEN {_bk(f'((g.t - i.time) / {_BW})', f'(g.t / {_BW})')} ELSE 0.0 END
    WHEN ({_TMAX} - g.t) / {_BW} < 1 THEN CASE WHEN (i.time - g.t) / {_BW} <= ({_TMAX} - g.t) / {_BW}
         THEN {_bk(f'((i.time - g.t) / {_BW})', f'(({_TMAX} - g.t) / {_BW})')} ELSE 0.0 END
    ELSE 0.75 * (1.0 - ((g.t - i.time) / {_BW}) * ((g.t - i.time) / {_BW})) END * i.dh), 0.0) / {_BW}, 8) AS hazard
FROM (SELECT 0.0 + CAST(j AS DOUBLE) * {_STEP!r} AS t FROM range(0, {_GRID_N}) r(j)) g
LEFT JOIN inc i ON abs((g.t - i.time) / {_BW}) <= 1
GROUP BY g.t"""


@query("hazard_kernel", sql=with_derived(
    _HK_BODY,
    """km_in AS (SELECT CAST(reply_time AS DOUBLE) AS time, event FROM d WHERE reply_time IS NOT NULL AND event IS NOT NULL),"""
    + km_sql("km_in") + """,
inc AS (SELECT time, CAST(n_event AS DOUBLE) / CAST(n_risk AS DOUBLE) AS dh FROM km WHERE n_event > 0)"""))
def hazard_kernel(spark, sf_dir):
    """Epanechnikov-smoothed hazard of reply (bandwidth 5 days, 0-70 days, boundary corrected)."""
    pairs = S.survival_pair(derived(spark, sf_dir), "reply_time", "event")
    return rounded(S.hazard_kernel(pairs, _BW, 0.0, _TMAX, _GRID_N), 8)


@query("hazard_piecewise", sql=with_derived(
    "SELECT CAST(b AS DOUBLE) AS bin_start, events, round(person_time, 6) AS person_time, "
    "round(CAST(events AS DOUBLE) / person_time, 8) AS hazard, "
    "round(greatest(0.0, CAST(events AS DOUBLE) / person_time - 1.959963984540054 * sqrt(CAST(events AS DOUBLE)) / person_time), 8) AS lower, "
    "round(CAST(events AS DOUBLE) / person_time + 1.959963984540054 * sqrt(CAST(events AS DOUBLE)) / person_time, 8) AS upper "
    "FROM (SELECT r.b, sum(t.n_at * (least(t.time, r.b + 1.0) - r.b)) AS person_time, "
    "CAST(sum(CASE WHEN t.time > r.b AND t.time <= r.b + 1.0 THEN t.n_event ELSE 0 END) AS BIGINT) AS events "
    "FROM range(0, 70) r(b) JOIN km_t t ON t.time > r.b GROUP BY r.b) x",
    """km_in AS (SELECT CAST(reply_time AS DOUBLE) AS time, event FROM d WHERE reply_time IS NOT NULL AND event IS NOT NULL),"""
    + km_sql("km_in")))
def hazard_piecewise(spark, sf_dir):
    """Events per person-day in 1-day bins up to 70 days, with 95% limits."""
    pairs = S.survival_pair(derived(spark, sf_dir), "reply_time", "event")
    out = S.hazard_piecewise(pairs, 1.0, 70.0)
    return out.select("bin_start", "events", F.round("person_time", 6).alias("person_time"),
                      F.round("hazard", 8).alias("hazard"), F.round("lower", 8).alias("lower"),
                      F.round("upper", 8).alias("upper"))


@query("km_by_wave", sql=with_waves(
    f"SELECT wave, {_KM_COLS} FROM km",
    """km_in AS (SELECT wave, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL),""" + km_sql("km_in", "wave")))
def km_by_wave(spark, sf_dir):
    """Kaplan-Meier of reply time in each of four waves (per-wave censoring, window partitioned by wave)."""
    d = derive_wave(all_waves(spark, sf_dir), censor_by=("wave",))
    pairs = S.survival_pair(d, "reply_time", "event", by=("wave",))
    return rounded(S.kaplan_meier(pairs, by=("wave",), conf=False), 8)


_HKG_BODY = f"""
SELECT gr.overall_tri, gr.t AS time, round(coalesce(sum(CASE
    WHEN abs((gr.t - i.time) / {_BW}) > 1 THEN 0.0
    WHEN gr.t / {_BW} < 1 THEN CASE WHEN (gr.t - i.time) / {_BW} <= gr.t / {_BW}
         THEN {_bk(f'((gr.t - i.time) / {_BW})', f'(gr.t / {_BW})')} ELSE 0.0 END
    WHEN ({_TMAX} - gr.t) / {_BW} < 1 THEN CASE WHEN (i.time - gr.t) / {_BW} <= ({_TMAX} - gr.t) / {_BW}
         THEN {_bk(f'((i.time - gr.t) / {_BW})', f'(({_TMAX} - gr.t) / {_BW})')} ELSE 0.0 END
    ELSE 0.75 * (1.0 - ((gr.t - i.time) / {_BW}) * ((gr.t - i.time) / {_BW})) END * i.dh), 0.0) / {_BW}, 8) AS hazard
FROM (SELECT g.overall_tri, 0.0 + CAST(j AS DOUBLE) * {_STEP!r} AS t
      FROM (SELECT DISTINCT overall_tri FROM inc) g, range(0, {_GRID_N}) r(j)) gr
LEFT JOIN inc i ON i.overall_tri = gr.overall_tri AND abs((gr.t - i.time) / {_BW}) <= 1
GROUP BY gr.overall_tri, gr.t"""


@query("hazard_kernel_by_group", sql=with_derived(
    _HKG_BODY,
    """km_in AS (SELECT overall_tri, CAST(reply_time AS DOUBLE) AS time, event FROM d
               WHERE reply_time IS NOT NULL AND event IS NOT NULL AND overall_tri IS NOT NULL),"""
    + km_sql("km_in", "overall_tri") + """,
inc AS (SELECT overall_tri, time, CAST(n_event AS DOUBLE) / CAST(n_risk AS DOUBLE) AS dh FROM km WHERE n_event > 0)"""))
def hazard_kernel_by_group(spark, sf_dir):
    """Kernel-smoothed hazard of reply per satisfaction group (bandwidth 5 days, 0-70 days)."""
    d = derived(spark, sf_dir).where(F.col("overall_tri").isNotNull())
    pairs = S.survival_pair(d, "reply_time", "event", by=("overall_tri",))
    return rounded(S.hazard_kernel(pairs, _BW, 0.0, _TMAX, _GRID_N, by=("overall_tri",)), 8)


#: Candidate bandwidths of the local hazard, exact in binary.
_BWS = [2.0 + 0.5 * k for k in range(26)]
_SMOOTH = 25.0


def _kernel_sql(g: str, t: str, b: str) -> str:
    """Boundary-corrected Epanechnikov weight of time t at g on 0.._TMAX."""
    x, y, ql, qr = f"(({g} - {t}) / {b})", f"(({t} - {g}) / {b})", f"({g} / {b})", f"(({_TMAX} - {g}) / {b})"
    return (f"CASE WHEN abs({x}) > 1 THEN 0.0E0 WHEN {ql} < 1 THEN CASE WHEN {x} <= {ql} THEN {_bk(x, ql)} ELSE 0.0E0 END "
            f"WHEN {qr} < 1 THEN CASE WHEN {y} <= {qr} THEN {_bk(y, qr)} ELSE 0.0E0 END "
            f"ELSE 0.75E0 * (1.0E0 - {x} * {x}) END")


_LOCAL_SQL = f"""
grid AS (SELECT CAST(j AS INT) AS j, 0.0E0 + CAST(j AS DOUBLE) * {_STEP!r} AS g FROM range(0, {_GRID_N}) r(j)),
h0 AS (SELECT g.j, g.g, coalesce(sum({_kernel_sql('g.g', 'i.time', f'{_BW}E0')} * i.dh), 0.0E0) / {_BW} AS h,
    (SELECT count(*) FROM km_in k WHERE floor(k.time / {_STEP!r} + 1e-9) >= g.j
       OR (g.j = {_GRID_N - 1} AND k.time / {_STEP!r} >= g.j)) AS y
  FROM grid g LEFT JOIN inc i ON abs(g.g - i.time) <= {_BW} GROUP BY g.j, g.g),
ks AS (SELECT z.j, b.b, z.h AS hz, {_kernel_sql('z.g', 'u.g', 'b.b')} AS k, u.h AS hu,
    CASE WHEN u.y > 0 THEN u.h / (u.y * {_STEP!r}) ELSE 0.0E0 END AS v
  FROM h0 z, h0 u, (SELECT 2.0E0 + 0.5E0 * CAST(k AS DOUBLE) AS b FROM range(0, {len(_BWS)}) r(k)) b),
err AS (SELECT j, b, round(pow(sum(k * hu) / sum(k) - max(hz), 2) + sum(k * k * v) / (sum(k) * sum(k)), 12) AS mse
  FROM ks GROUP BY j, b HAVING sum(k) > 0),
best AS (SELECT j, b FROM (SELECT j, b, row_number() OVER (PARTITION BY j ORDER BY mse, b) AS r FROM err) e WHERE r = 1),
sm AS (SELECT g.j, g.g, sum((1.0E0 - pow((g.j - u.j) * {_STEP / _SMOOTH!r}, 2)) * u.b)
      / sum(1.0E0 - pow((g.j - u.j) * {_STEP / _SMOOTH!r}, 2)) AS b
  FROM grid g JOIN best u ON abs(g.j - u.j) <= {_SMOOTH / _STEP!r} GROUP BY g.j, g.g)"""


@query("hazard_kernel_local", sql=with_derived(
    f"SELECT s.g AS time, round(s.b, 8) AS bandwidth, round(coalesce(sum({_kernel_sql('s.g', 'i.time', 's.b')} * i.dh / s.b), "
    "0.0E0), 8) AS hazard FROM sm s LEFT JOIN inc i ON abs(s.g - i.time) <= s.b GROUP BY s.g, s.b",
    """km_in AS (SELECT CAST(reply_time AS DOUBLE) AS time, event FROM d WHERE reply_time IS NOT NULL AND event IS NOT NULL),"""
    + km_sql("km_in") + """,
inc AS (SELECT time, CAST(n_event AS DOUBLE) / CAST(n_risk AS DOUBLE) AS dh FROM km WHERE n_event > 0),""" + _LOCAL_SQL))
def hazard_kernel_local(spark, sf_dir):
    """Hazard of reply, 0-70 days, with a bandwidth chosen for each time by its estimated squared error."""
    pairs = S.survival_pair(derived(spark, sf_dir), "reply_time", "event")
    return rounded(S.hazard_kernel_local(pairs, _BW, _BWS, _SMOOTH, 0.0, _TMAX, _GRID_N), 8)
