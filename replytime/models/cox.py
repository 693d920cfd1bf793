"""Cox proportional hazards with Efron ties, on Spark aggregates.

Each Newton step:

1. rows collapsed once to (pattern, time) with event and row counts
   (checkpointed);
2. one ``groupBy(time)`` gives, per distinct time, the sums of r = exp(x'b)
   (and r x, r x x') over all rows and over the tied events;
3. risk-set sums are reverse running sums over the distinct times (a window
   over ~one row per day, bounded by the time domain);
4. the Efron tie correction needs, per time with d tied events, six scalar
   sums over l = 0..d-1 of functions of (S0 - l/d e0).  A pandas UDF on the
   per-time table evaluates them for all times at once by one formula whose
   cost does not depend on d;
5. one global aggregate returns log-likelihood, score and information.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import chi2_sf, norm_sf
from ..operators.prefix import BLOCK, MANY, in_blocks, running
from .design import Design, build_design, coef_frame, complete_rows, linear_predictor, sym_from_upper, upper_pairs
from .suffstats import agg_vector, collapse, inv_sym, newton

#: Terms nearest to the end of a tie sum that are added one by one.
TAIL = 64
#: B_2k / (2k)! for k = 1..4
_BERNOULLI = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def _log_rests(w: np.ndarray):
    """r1 = -log(1-w) - w and r2 = r1 - w^2/2 without cancellation, for 0 <= w < 1."""
    k = np.arange(3, 60)
    small = np.minimum(w, 0.5)
    series = (small[:, None] ** k / k).sum(axis=1)
    log1 = -np.log1p(-w)
    r2 = np.where(w <= 0.5, series, log1 - w - w * w / 2)
    return r2 + w * w / 2, r2


def efron_sums(s0, e0, d):
    """(L, A0, A1, B0, B1, B2) = sums over l < d of
    log D, 1/D, (l/d)/D, 1/D^2, (l/d)/D^2, (l/d)^2/D^2 with D = s0 - (l/d) e0.

    One formula for every d: with u = l/d, q = e0/s0 and D = s0 (1 - q u), the
    last TAIL terms (where D may come near zero) are added one by one; the
    terms before them are the Euler-Maclaurin formula, the integral of the
    smooth function plus corrections at both ends.  The integrals are written
    with the remainders of the logarithm's series, so small q cancels nothing.
    Arguments are numbers or arrays; the cost does not depend on d.
    """
    s0, e0, d = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (s0, e0, d))
    q = e0 / s0
    n = np.maximum(d - TAIL, 0.0)          # terms of the smooth part
    a = n / d
    w = q * a
    t = 1.0 - w
    r1, r2 = _log_rests(w)
    safe = np.where(w > 0, q, 1.0)         # without a smooth part all integrals are 0
    integral = [
        -(w * w - t * r1) / safe,                      # log(1 - q u)
        -np.log1p(-w) / safe,                          # 1 / (1 - q u)
        r1 / safe ** 2,                                # u / (1 - q u)
        a / t,                                         # 1 / (1 - q u)^2
        (w * w / t - r1) / safe ** 2,                  # u / (1 - q u)^2
        (w ** 3 / t - 2.0 * r2) / safe ** 3,           # u^2 / (1 - q u)^2
    ]

    def at(u, m):
        """The six functions' m-th derivatives at u (m = 0 or odd)."""
        x = 1.0 - q * u
        if m == 0:
            return [np.log1p(-q * u), 1 / x, u / x, 1 / x ** 2, u / x ** 2, (u / x) ** 2]
        f, f1 = float(math.factorial(m)), float(math.factorial(m + 1))
        inv, inv2 = f * x ** -(m + 1), f1 * x ** -(m + 2)
        bend = q ** (m - 2) * (inv2 - 2.0 * inv) if m > 1 else 2.0 * u * x ** -3
        return [-math.factorial(m - 1) * q ** m * x ** -m, q ** m * inv, q ** (m - 1) * inv, q ** m * inv2,
                q ** (m - 1) * (inv2 - inv), bend]

    zero = np.zeros_like(a)
    out = [d * i + np.where(n > 0, (lo - hi) / 2, 0.0) for i, lo, hi in zip(integral, at(zero, 0), at(a, 0))]
    for k, c in enumerate(_BERNOULLI, 1):
        m = 2 * k - 1
        out = [o + np.where(n > 0, c * (hi - lo) / d ** m, 0.0) for o, lo, hi in zip(out, at(zero, m), at(a, m))]
    steps = np.arange(TAIL, dtype=float)[None, :]
    use = steps < (d - n)[:, None]
    u = np.where(use, (n[:, None] + steps) / d[:, None], 0.0)
    x = 1.0 - q[:, None] * u
    tail = [np.log1p(-q[:, None] * u), 1 / x, u / x, 1 / x ** 2, u / x ** 2, (u / x) ** 2]
    out = [o + np.where(use, v, 0.0).sum(axis=1) for o, v in zip(out, tail)]
    out[0] = out[0] + d * np.log(s0)
    return out[0], out[1] / s0, out[2] / s0, out[3] / s0 ** 2, out[4] / s0 ** 2, out[5] / s0 ** 2


_EFRON_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("L", "A0", "A1", "B0", "B1", "B2")])


@F.pandas_udf(_EFRON_TYPE)
def _efron_udf(s0: pd.Series, e0: pd.Series, d: pd.Series) -> pd.DataFrame:
    some = (d > 0).to_numpy()
    out = np.zeros((len(d), 6))
    if some.any():
        out[some] = np.column_stack(efron_sums(s0.to_numpy()[some], e0.to_numpy()[some], d.to_numpy()[some]))
    return pd.DataFrame(out, columns=["L", "A0", "A1", "B0", "B1", "B2"])


@dataclass
class CoxFit:
    """Fitted Cox model (Efron ties); the design is centred at ``means``."""
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    loglik0: float
    n: int
    n_events: int
    iterations: int
    means: np.ndarray
    robust_cov: np.ndarray | None = None
    collapsed: DataFrame | None = None   # checkpointed (pattern, time) counts, reused by later steps
    ties: str = "efron"

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))

    def table(self, spark, robust: bool = False) -> DataFrame:
        cov = self.robust_cov if (robust and self.robust_cov is not None) else self.cov
        se = np.sqrt(np.diag(cov))
        z = self.beta / se
        p = [2.0 * norm_sf(abs(float(v))) for v in z]
        return coef_frame(spark, self.design.names, self.beta, se, z, p)

    def lr_test(self):
        stat = 2.0 * (self.loglik - self.loglik0)
        return stat, len(self.beta), chi2_sf(stat, len(self.beta))


def cox_frame(df: DataFrame, design: Design, time: str, event: str, keep=()) -> DataFrame:
    """Complete rows with design columns, time and event."""
    rows = complete_rows(df, design, extra=[time, event])
    return rows.select(*keep, *[e.alias(f"x{i}") for i, e in enumerate(design.exprs)],
                       F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"))


def _axis(coll: DataFrame) -> list[str]:
    """The time column, and the block of the time axis where there are blocks."""
    return [BLOCK, "time"] if BLOCK in coll.columns else ["time"]


def per_time_table(coll: DataFrame, beta, p: int, ties: str = "efron") -> DataFrame:
    """Per distinct time: event count, event/at-risk sums of r, r x, r x x' and risk-set sums.

    Column ``ef`` holds the tie sums (L, A0, A1, B0, B1, B2): Efron's through
    the pandas UDF, Breslow's in closed form (L = d log S0, A0 = d/S0,
    B0 = d/S0^2, the rest 0) as plain Column expressions.
    """
    eta = linear_predictor(beta, p)
    pairs = upper_pairs(p)
    base = coll.select(*_axis(coll), *[f"x{j}" for j in range(p)], "n_at", "n_ev", eta.alias("eta"),
                       F.exp(eta).alias("r"))
    # SQL text: one JVM call per aggregate
    aggs = ["sum(n_ev) AS d", "sum(n_ev * eta) AS seta", "sum(n_at * r) AS a0", "sum(n_ev * r) AS e0"]
    aggs += [f"sum(n_at * r * x{j}) AS a1_{j}" for j in range(p)]
    aggs += [f"sum(n_ev * r * x{j}) AS e1_{j}" for j in range(p)]
    aggs += [f"sum(n_ev * x{j}) AS sx_{j}" for j in range(p)]
    aggs += [f"sum(n_at * r * x{a} * x{b}) AS a2_{a}_{b}" for a, b in pairs]
    aggs += [f"sum(n_ev * r * x{a} * x{b}) AS e2_{a}_{b}" for a, b in pairs]
    risk = {"S0": "a0"} | {f"S1_{j}": f"a1_{j}" for j in range(p)} | {f"S2_{a}_{b}": f"a2_{a}_{b}" for a, b in pairs}
    if BLOCK in coll.columns:
        # many distinct times: the table is dealt by ranges of time, a time lies in one block
        t = running(base.groupBy(BLOCK, "time").agg(*[F.expr(e) for e in aggs]), risk, "time", descending=True)
    else:
        win = "OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        t = base.groupBy("time").agg(*[F.expr(e) for e in aggs]).selectExpr(
            "*", *[f"sum({e}) {win} AS {name}" for name, e in risk.items()])
    if ties == "breslow":
        d, s0 = F.col("d"), F.col("S0")
        zero = F.lit(0.0)
        ef = F.struct(F.when(d > 0, d * F.ln(s0)).otherwise(zero).alias("L"), (d / s0).alias("A0"),
                      zero.alias("A1"), (d / (s0 * s0)).alias("B0"), zero.alias("B1"), zero.alias("B2"))
        return t.withColumn("ef", ef)
    return t.withColumn("ef", _efron_udf(F.col("S0"), F.col("e0"), F.col("d")))


def _step_pieces(coll: DataFrame, beta, p: int, ties: str = "efron"):
    t = per_time_table(coll, beta, p, ties).where(F.col("d") > 0)
    pairs = upper_pairs(p)
    exprs = ["sum(seta - ef.L)"]
    exprs += [f"sum(sx_{j} - (S1_{j} * ef.A0 - e1_{j} * ef.A1))" for j in range(p)]
    for a, b in pairs:
        exprs.append(f"sum(S2_{a}_{b} * ef.A0 - e2_{a}_{b} * ef.A1 - (S1_{a} * S1_{b} * ef.B0 "
                     f"- (S1_{a} * e1_{b} + e1_{a} * S1_{b}) * ef.B1 + e1_{a} * e1_{b} * ef.B2))")
    v = agg_vector(t, exprs)
    return float(v[0]), v[1:p + 1], sym_from_upper(v[p + 1:], p)


def fit_cox(df: DataFrame, time: str, event: str, terms, design: Design | None = None,
            cluster: str | None = None, tol: float = 1e-9, max_iter: int = 100, ties: str = "efron",
            many: int = MANY) -> CoxFit:
    """Cox model by Newton-Raphson with step halving; ``ties`` is "efron" (default) or "breslow".

    With more than ``many`` distinct times the risk sets are summed in blocks of the time axis.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    design = design or build_design(df, terms, intercept=False)
    p = design.p
    frame = cox_frame(df, design, time, event, keep=[cluster] if cluster else [])
    keys = [f"x{i}" for i in range(p)] + ["time"]
    counts = {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")}
    coll_c = None
    if cluster:
        # one pass over the rows: collapse with the cluster key, regroup without it
        coll_c = collapse(frame, [cluster] + keys, counts)
        coll = coll_c.groupBy(*keys).agg(F.sum("n_at").alias("n_at"), F.sum("n_ev").alias("n_ev")).checkpoint(
            eager=True)
    else:
        coll = collapse(frame, keys, counts)
    if coll.select("time").distinct().count() > many:
        coll = in_blocks(coll, "time")
        coll_c = coll_c and in_blocks(coll_c, "time")
    # centre the design at its means (as is customary; keeps exp(x'b) moderate)
    mv = agg_vector(coll, [F.sum(F.col("n_at") * F.col(f"x{j}")) for j in range(p)]
                    + [F.sum("n_at"), F.sum("n_ev")])
    n, n_ev = int(mv[p]), int(mv[p + 1])
    means = mv[:p] / mv[p]
    cc = coll.select(*[(F.col(f"x{j}") - F.lit(float(means[j]))).alias(f"x{j}") for j in range(p)],
                     *_axis(coll), "n_at", "n_ev")

    def evaluate(beta):
        ll, u, info = _step_pieces(cc, beta, p, ties)
        return u, -info, ll

    _, _, ll0 = evaluate(np.zeros(p))
    beta, _, h, ll, it = newton(evaluate, np.zeros(p), "Cox model", tol, max_iter)
    info = -h
    fit = CoxFit(design, beta, inv_sym(info), ll, ll0, n, n_ev, it, means, collapsed=coll, ties=ties)
    if cluster:
        fit.robust_cov = robust_cov(df, fit, time, event, cluster, collapsed=coll_c)
    return fit


def _centred(df: DataFrame, fit: CoxFit, time: str, event: str) -> DataFrame:
    """The fit's collapsed (pattern, time) counts with the design centred at its means.

    Reuses the checkpoint made during the fit; only a fit without one
    collapses the rows again.
    """
    p = fit.design.p
    coll = fit.collapsed
    if coll is None:
        frame = cox_frame(df, fit.design, time, event)
        coll = collapse(frame, [f"x{i}" for i in range(p)] + ["time"],
                        {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")},
                        checkpoint=False)
    return coll.select(*[(F.col(f"x{j}") - F.lit(float(fit.means[j]))).alias(f"x{j}") for j in range(p)],
                       *_axis(coll), "n_at", "n_ev")


def schoenfeld_test(df: DataFrame, fit: CoxFit, time: str, event: str, spark,
                    transform: str = "km") -> DataFrame:
    """Proportional-hazards check: scaled Schoenfeld residuals against a function g of time.

    Residual of an event at t: x - xbar(t), with the tie-weighted mean
    xbar(t) = (S1 A0 - e1 A1) / d.  Per covariate j the statistic
    T_j = (sum_k (g_k - gbar) s*_kj)^2 / (D V_jj sum_k (g_k - gbar)^2), s* the
    scaled residual, is referred to chi-square(1).  ``transform``: "km"
    (g = 1 - the pooled left-continuous Kaplan-Meier estimate at t), "rank"
    (rank of the distinct event time) or "identity" (g = t).  Sums run as
    Spark aggregates over the collapsed rows joined to the per-time table.
    """
    p = fit.design.p
    cc = _centred(df, fit, time, event)
    pt = per_time_table(cc, fit.beta, p, fit.ties)
    blocked = BLOCK in cc.columns
    w_prev = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    if transform == "km" and blocked:
        cnt = running(cc.groupBy(BLOCK, "time").agg(F.sum("n_at").alias("n_at_t"), F.sum("n_ev").alias("n_ev_t")),
                      {"n_risk": "n_at_t"}, "time", descending=True)
        step = F.when(F.col("n_ev_t") < F.col("n_risk"), F.ln(F.lit(1.0) - F.col("n_ev_t") / F.col("n_risk"))).otherwise(0.0)
        gt = running(cnt.withColumn("_step", step), {"_upto": "_step"}, "time").select(
            "time", (F.lit(1.0) - F.exp(F.col("_upto") - F.col("_step"))).alias("g"))
    elif transform == "rank" and blocked:
        gt = running(pt.where(F.col("d") > 0), {"g": F.lit(1.0)}, "time").select("time", "g")
    elif transform == "km":
        # counts per distinct time -> KM just before t (all rows at risk at t)
        cnt = cc.groupBy("time").agg(F.sum("n_at").alias("n_at_t"), F.sum("n_ev").alias("n_ev_t"))
        w_all = Window.partitionBy(F.lit(0))
        n_risk = F.sum("n_at_t").over(w_all) - F.coalesce(F.sum("n_at_t").over(w_prev), F.lit(0.0))
        cnt = cnt.withColumn("n_risk", n_risk).withColumn(
            "_step", F.when(F.col("n_ev_t") < F.col("n_risk"), F.ln(F.lit(1.0) - F.col("n_ev_t") / F.col("n_risk"))))
        gcol = F.lit(1.0) - F.exp(F.coalesce(F.sum("_step").over(w_prev), F.lit(0.0)))
        gt = cnt.select("time", gcol.alias("g"))
    elif transform == "rank":
        gt = pt.where(F.col("d") > 0).select("time", F.dense_rank().over(
            Window.partitionBy(F.lit(0)).orderBy("time")).cast("double").alias("g"))
    elif transform == "identity":
        gt = pt.select("time", F.col("time").alias("g"))
    else:
        raise ValueError("transform must be 'km', 'rank' or 'identity'")
    xbar = pt.where(F.col("d") > 0).select(
        "time", *[((F.col(f"S1_{j}") * F.col("ef.A0") - F.col(f"e1_{j}") * F.col("ef.A1"))
                   / F.col("d")).alias(f"xb_{j}") for j in range(p)]).join(gt, "time")
    ev = cc.where(F.col("n_ev") > 0).join(xbar, "time")
    m = agg_vector(ev, [F.sum(F.col("n_ev") * F.col("g")), F.sum("n_ev")])
    gbar, dtot = m[0] / m[1], m[1]
    gc = F.col("g") - F.lit(gbar)
    res = [F.col(f"x{j}") - F.col(f"xb_{j}") for j in range(p)]
    v = agg_vector(ev, [F.sum(F.col("n_ev") * gc * res[j]) for j in range(p)]
                   + [F.sum(F.col("n_ev") * gc * gc)])
    sgr, sgg = v[:p], v[p]
    # scaled residuals s*_k = beta + D V r_k  =>  sum g s* = D V (sum g r)
    sg_scaled = dtot * (fit.cov @ sgr)
    rows = []
    for j in range(p):
        stat = sg_scaled[j] ** 2 / (dtot * fit.cov[j, j] * sgg)
        rows.append((fit.design.names[j], float(sg_scaled[j]), float(stat), 1, chi2_sf(float(stat), 1.0)))
    # all covariates together: the same sums as one quadratic form
    total = float(dtot * (sgr @ fit.cov @ sgr) / sgg)
    rows.append(("GLOBAL", None, total, p, chi2_sf(total, float(p))))
    schema = "term string, sum_g_scaled double, chisq double, df int, p_value double"
    return spark.createDataFrame(rows, schema)


def baseline_hazard(df: DataFrame, fit: CoxFit, time: str, event: str) -> DataFrame:
    """Efron baseline cumulative hazard H0(t) at the covariate means (per distinct time)."""
    p = fit.design.p
    cc = _centred(df, fit, time, event)
    pt = per_time_table(cc, fit.beta, p, fit.ties).select(*_axis(cc), "d", F.coalesce(F.col("ef.A0"), F.lit(0.0)).alias("dH"))
    if BLOCK in cc.columns:
        return running(pt, {"cumhaz": "dH"}, "time").select("time", "d", "cumhaz")
    w = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return pt.select("time", "d", F.sum("dH").over(w).alias("cumhaz"))


def risk_score(fit: CoxFit) -> Column:
    """exp((x - mean)' beta) as a Column over the design expressions."""
    eta = F.lit(0.0)
    for b, e, m in zip(fit.beta, fit.design.exprs, fit.means):
        eta = eta + F.lit(float(b)) * (e - F.lit(float(m)))
    return F.exp(eta)


def robust_cov(df: DataFrame, fit: CoxFit, time: str, event: str, cluster: str,
               collapsed: DataFrame | None = None) -> np.ndarray:
    """Cluster-robust covariance I^-1 (sum_c U_c U_c') I^-1 from Efron score residuals.

    Score residual of subject i (x centred, r = exp(x'b)):
        U_i = delta_i [x_i - (S1 A0 - e1 A1)/d](T_i) - r_i [x_i H(T_i-) - G(T_i-)] - r_i c_i(T_i)
    with H(t-) = sum_{s < t} A0(s), G(t-) = sum_{s < t} (S1 B0 - e1 B1)(s), and at T_i
    c_i = x_i (A0 - A1) - (S1 (B0 - B1) - e1 (B1 - B2)) for a death (Efron weights 1 - l/d),
    c_i = x_i A0 - (S1 B0 - e1 B1) for a censoring.  The per-time quantities and their
    running sums live in the small per-time table, joined to rows collapsed by
    (cluster, pattern, time); ``groupBy(cluster)`` sums the residuals (partial
    aggregation first) and one more aggregate forms the outer products.
    """
    p = fit.design.p
    coll = collapsed
    if coll is None:
        frame = cox_frame(df, fit.design, time, event, keep=[cluster])
        coll = collapse(frame, [cluster] + [f"x{i}" for i in range(p)] + ["time"],
                        {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")})
    cc = coll.select(cluster, *[(F.col(f"x{j}") - F.lit(float(fit.means[j]))).alias(f"x{j}") for j in range(p)],
                     *_axis(coll), "n_at", "n_ev")
    pt = per_time_table(cc.drop(cluster), fit.beta, p, fit.ties)
    A0, A1 = F.col("ef.A0"), F.col("ef.A1")
    B0, B1, B2 = F.col("ef.B0"), F.col("ef.B1"), F.col("ef.B2")
    d = F.col("d")
    cols = {"A0": A0, "A1": A1, "dA": A0 - A1}
    for j in range(p):
        s1, e1 = F.col(f"S1_{j}"), F.col(f"e1_{j}")
        cols[f"xbar_{j}"] = F.when(d > 0, (s1 * A0 - e1 * A1) / d).otherwise(F.lit(0.0))
        cols[f"now_{j}"] = s1 * B0 - e1 * B1
        cols[f"gd_{j}"] = s1 * (B0 - B1) - e1 * (B1 - B2)
    pt = pt.select(*_axis(cc), *[v.alias(k) for k, v in cols.items()])
    before = {"H": "A0"} | {f"G_{j}": f"now_{j}" for j in range(p)}  # sums over earlier times
    if BLOCK in cc.columns:
        own = {name: F.coalesce(F.col(e), F.lit(0.0)) for name, e in before.items()}
        pt = running(pt, own, "time").withColumns({name: F.col(name) - e for name, e in own.items()}).drop(BLOCK)
    else:
        w = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
        pt = pt.withColumns({name: F.coalesce(F.sum(e).over(w), F.lit(0.0)) for name, e in before.items()})
    rows = cc.join(pt, "time")
    eta = linear_predictor(fit.beta, p)
    r = F.exp(eta)
    ne, nc = F.col("n_ev"), F.col("n_at") - F.col("n_ev")
    u = []
    for j in range(p):
        x = F.col(f"x{j}")
        prior = x * F.col("H") - F.col(f"G_{j}")
        death = (x - F.col(f"xbar_{j}")) - r * (prior + x * F.col("dA") - F.col(f"gd_{j}"))
        cens = -r * (prior + x * F.col("A0") - F.col(f"now_{j}"))
        u.append(ne * death + nc * cens)
    per = rows.groupBy(cluster).agg(*[F.sum(e).alias(f"u{k}") for k, e in enumerate(u)])
    uu = [F.col(f"u{k}") for k in range(p)]
    meat = sym_from_upper(agg_vector(per, [F.sum(uu[a] * uu[b]) for a, b in upper_pairs(p)]), p)
    return fit.cov @ meat @ fit.cov
