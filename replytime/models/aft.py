"""Accelerated failure time models.

* Log-logistic and Weibull: Newton-Raphson on (beta, log sigma) where the
  gradient, Hessian and log-likelihood of each step are ONE Spark aggregate
  over rows collapsed to distinct (pattern, time, event) with counts.
* Cluster-robust (sandwich) covariance: per-row scores summed within each
  cluster by ``groupBy(cluster)``, then the outer products summed by a
  second aggregate - only a p x p matrix reaches the driver.

Model (log-logistic): log T = x'beta + sigma * W, W standard logistic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_sf
from .design import (Design, build_design, coef_frame, complete_rows, linear_predictor, sym_from_upper,
                     upper_pairs)
from .suffstats import agg_vector, collapse, inv_sym, newton


@dataclass
class AFTFit:
    """Fitted AFT model: coefficients, log scale, model-based and robust covariance."""
    design: Design
    beta: np.ndarray
    log_scale: float
    cov: np.ndarray          # model-based, over (beta, log_scale)
    robust_cov: np.ndarray | None
    loglik: float            # on the time scale (log-time density minus sum of log t over events)
    n: int
    n_events: int
    iterations: int
    dist: str = "loglogistic"

    @property
    def scale(self) -> float:
        return float(np.exp(self.log_scale))

    @property
    def names(self):
        return list(self.design.names) + ["Log(scale)"]

    @property
    def theta(self):
        return np.append(self.beta, self.log_scale)

    def table(self, spark, robust: bool = True) -> DataFrame:
        cov = self.robust_cov if (robust and self.robust_cov is not None) else self.cov
        se = np.sqrt(np.diag(cov))
        z = self.theta / se
        p = [2.0 * norm_sf(abs(float(v))) for v in z]
        return coef_frame(spark, self.names, self.theta, se, z, p)

    def linear_score(self) -> Column:
        eta = F.lit(0.0)
        for b, e in zip(self.beta, self.design.exprs):
            eta = eta + F.lit(float(b)) * e
        return eta


def _logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _softplus(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def _row_terms(beta, tau: float, p: int, dist: str = "loglogistic"):
    """Per-row pieces as Columns: z, dl/dz, d2l/dz2, log-likelihood (log-time scale)."""
    sigma = float(np.exp(tau))
    eta = linear_predictor(beta, p)
    z = (F.col("logt") - eta) / F.lit(sigma)
    ev = F.col("event") == 1
    if dist == "weibull":
        # event: -tau + z - e^z;  censored: -e^z
        ez = F.exp(z)
        return z, F.when(ev, F.lit(1.0) - ez).otherwise(-ez), -ez, F.when(ev, F.lit(-tau) + z - ez).otherwise(-ez), sigma
    pz = _logistic(z)
    dl = F.when(ev, F.lit(1.0) - F.lit(2.0) * pz).otherwise(-pz)
    d2l = F.when(ev, F.lit(-2.0) * pz * (F.lit(1.0) - pz)).otherwise(-pz * (F.lit(1.0) - pz))
    # event: -tau + z - 2 log(1 + e^z);  censored: -log(1 + e^z)
    ll = F.when(ev, F.lit(-tau) + z - F.lit(2.0) * _softplus(z)).otherwise(-_softplus(z))
    return z, dl, d2l, ll, sigma


def _score_columns(beta, tau: float, p: int, dist: str = "loglogistic"):
    """Per-row score vector (beta..., log sigma) as Columns."""
    z, dl, _, _, sigma = _row_terms(beta, tau, p, dist)
    ev = F.col("event") == 1
    u = [-dl * F.col(f"x{j}") / F.lit(sigma) for j in range(p)]
    u.append(F.when(ev, F.lit(-1.0)).otherwise(F.lit(0.0)) - dl * z)
    return u


def _newton_pieces(coll: DataFrame, beta, tau: float, p: int, w: Column, dist: str = "loglogistic"):
    z, dl, d2l, ll, sigma = _row_terms(beta, tau, p, dist)
    # per-row pieces once, in a projection below the aggregate
    coll = coll.select(w.alias("w"), "event", *[F.col(f"x{j}") for j in range(p)], z.alias("z"),
                       dl.alias("dl"), d2l.alias("d2l"), ll.alias("ll"))
    s, s2 = repr(float(sigma)), repr(float(sigma * sigma))
    exprs = [f"sum(w * (-dl) * x{j}) / {s}D" for j in range(p)]
    exprs.append("sum(w * (CASE WHEN event = 1 THEN -1.0D ELSE 0.0D END - dl * z))")
    q = p + 1
    for a, b in upper_pairs(q):
        if a < p and b < p:
            e = f"sum(w * d2l * x{a} * x{b}) / {s2}D"
        elif a < p and b == p:
            e = f"sum(w * x{a} * (z * d2l + dl)) / {s}D"
        else:
            e = "sum(w * (z * z * d2l + z * dl))"
        exprs.append(e)
    exprs.append("sum(w * ll)")
    v = agg_vector(coll, exprs)
    g = v[:q]
    h = sym_from_upper(v[q:q + q * (q + 1) // 2], q)
    return g, h, float(v[-1])


def aft_frame(df: DataFrame, design: Design, time: str, event: str, keep=()) -> DataFrame:
    """Complete rows with design columns, log time and event (positive times only)."""
    rows = complete_rows(df, design, extra=[time, event]).where(F.col(time) > 0)
    return rows.select(*keep, *[e.alias(f"x{i}") for i, e in enumerate(design.exprs)],
                       F.ln(F.col(time).cast("double")).alias("logt"), F.col(event).cast("int").alias("event"))


def fit_loglogistic(df: DataFrame, time: str, event: str, terms, cluster: str | None = None,
                    intercept: bool = True, design: Design | None = None, tol: float = 1e-9,
                    max_iter: int = 100, count: str | None = None) -> AFTFit:
    """Log-logistic AFT by maximum likelihood; robust covariance when ``cluster`` is given.

    ``count`` names a column with the number of rows that a row stands for (a table collapsed before).
    """
    return fit_aft(df, time, event, terms, cluster, intercept, design, tol, max_iter, "loglogistic", count)


def fit_weibull(df: DataFrame, time: str, event: str, terms, cluster: str | None = None,
                intercept: bool = True, design: Design | None = None, tol: float = 1e-9,
                max_iter: int = 100) -> AFTFit:
    """Weibull AFT (log T = x'beta + sigma * W, W extreme value) by the same Newton steps."""
    return fit_aft(df, time, event, terms, cluster, intercept, design, tol, max_iter, "weibull")


def fit_aft(df: DataFrame, time: str, event: str, terms, cluster: str | None, intercept: bool,
            design: Design | None, tol: float, max_iter: int, dist: str, count: str | None = None) -> AFTFit:
    """AFT model of the named distribution."""
    design = design or build_design(df, terms, intercept)
    p = design.p
    frame = aft_frame(df, design, time, event, keep=[c for c in (cluster, count) if c])
    keys = [f"x{i}" for i in range(p)] + ["logt", "event"]
    rows = {"w": F.sum(count) if count else F.count(F.lit(1)).cast("double")}
    if cluster:
        # one pass over the rows: collapse with the cluster key; the Newton
        # table is that (small, checkpointed) table regrouped without it
        coll_c = collapse(frame, [cluster] + keys, rows)
        coll = coll_c.groupBy(*keys).agg(F.sum("w").alias("w")).checkpoint(eager=True)
    else:
        coll = collapse(frame, keys, rows)
    w = F.col("w")
    # start: intercept at the mean log time of events, log scale 0
    m = agg_vector(coll, [F.sum(F.when(F.col("event") == 1, w * F.col("logt"))),
                          F.sum(F.when(F.col("event") == 1, w)), F.sum(w)])
    beta = np.zeros(p)
    if intercept and m[1] > 0:
        beta[0] = m[0] / m[1]
    theta, _, h, ll, it = newton(lambda t: _newton_pieces(coll, t[:p], float(t[p]), p, w, dist), np.append(beta, 0.0),
                                 f"{dist} model", tol, max_iter)
    beta, tau = theta[:p], float(theta[p])
    cov = inv_sym(-h)
    n_ev = [m[1], m[2], m[0]]
    robust = None
    if cluster:
        # scores of the collapsed rows times their counts = sums of row scores
        scores = [F.col("w") * u for u in _score_columns(beta, tau, p, dist)]
        robust = sandwich(coll_c, cluster, scores, cov)
    return AFTFit(design, beta, tau, cov, robust, ll - float(n_ev[2]), int(n_ev[1]), int(n_ev[0]), it, dist)


def sandwich(frame: DataFrame, cluster: str, scores: list[Column], bread: np.ndarray) -> np.ndarray:
    """Cluster-robust covariance  bread * (sum_c U_c U_c') * bread.

    ``groupBy(cluster)`` sums the per-row scores (partial aggregation before
    the shuffle, so a cluster holding a third of the rows is still only one
    row per partition in the exchange); the outer products of the per-cluster
    sums are summed by a second aggregate.
    """
    q = len(scores)
    per = frame.groupBy(cluster).agg(*[F.sum(u).alias(f"u{k}") for k, u in enumerate(scores)])
    u = [F.col(f"u{k}") for k in range(q)]
    meat = sym_from_upper(agg_vector(per, [F.sum(u[a] * u[b]) for a, b in upper_pairs(q)]), q)
    return bread @ meat @ bread


def loglogistic_hazard(time: Column, lam: float, shape: float, form: str = "standard") -> Column:
    """Baseline hazard of a log-logistic time at ``time``.

    standard: lam * p * (lam t)^(p-1) / (1 + (lam t)^p), with p = 1/scale.
    source:   lam * rho * (lam t)^rho / (1 + (lam t)^(rho+1)), rho = scale (as the study wrote it).
    """
    t = time.cast("double")
    lt = F.lit(lam) * t
    if form == "source":
        rho = F.lit(shape)
        return F.lit(lam) * rho * F.pow(lt, rho) / (F.lit(1.0) + F.pow(lt, rho + F.lit(1.0)))
    pp = F.lit(shape)
    return F.when(t > 0, F.lit(lam) * pp * F.pow(lt, pp - F.lit(1.0)) / (F.lit(1.0) + F.pow(lt, pp)))
