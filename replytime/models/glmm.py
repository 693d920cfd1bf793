"""Logistic model with a random intercept per cluster (Laplace approximation).

For a given sd ``sigma`` of the cluster intercepts b_j, the intercepts follow
their conditional modes (maximisers of the penalised log-likelihood
sum_i [s eta - m log(1 + e^eta)] - b_j^2 / (2 sigma^2)) while beta climbs the
Laplace log-likelihood itself (its gradient adds the derivative of
-1/2 log h_j through b_j(beta)), by Newton-type steps.  The Hessian has one
scalar block per cluster, so the step is solved by block elimination
(Schur complement) with sums over clusters:

* one ``groupBy(g, cluster)`` over the collapsed rows gives each cluster's
  gradient and Hessian blocks;
* one ``groupBy(g)`` over those per-cluster rows gives the p x p Schur
  system; the driver solves it;
* the new intercepts are a column expression over the per-cluster rows
  (checkpointed each step; one row per (grid point, cluster)).

``g`` indexes a grid of sigma values fitted side by side in the same jobs.
The Laplace log-likelihood  sum_j [l_j(b_j) - log(sigma) - log(h_j)/2]
picks the best sigma; the grid is refined around it.  As sigma -> 0 the fit
reduces to the ordinary logit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_sf
from ..session import ensure_checkpoint_dir
from .design import Design, build_design, coef_frame, complete_rows, sym_from_upper, upper_pairs
from .suffstats import NotConverged, collapse, inv_sym, solve_sym


@dataclass
class MixedLogitFit:
    """Fitted random-intercept logistic regression."""
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    sigma_a: float
    loglik: float
    n: int
    n_groups: int
    modes: DataFrame | None = None   # (cluster, b): conditional modes of the intercepts; None without variance
    cluster: str = ""

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))

    def fitted(self, df: DataFrame, y: str, name: str = "fitted") -> DataFrame:
        """The rows of the fit with their fitted probability, the cluster's mode included."""
        rows = complete_rows(df.where(F.col(self.cluster).isNotNull()), self.design, extra=[y])
        if self.modes is not None:
            rows = rows.join(self.modes.withColumnRenamed("b", "mode__"), self.cluster, "left")
        else:
            rows = rows.withColumn("mode__", F.lit(0.0))
        eta = self.linear_score() + F.coalesce(F.col("mode__"), F.lit(0.0))
        return rows.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).drop("mode__")

    def table(self, spark) -> DataFrame:
        z = self.beta / self.se
        p = [2.0 * norm_sf(abs(float(v))) for v in z]
        names = list(self.design.names) + ["sd(Intercept)"]
        return coef_frame(spark, names, list(self.beta) + [self.sigma_a], list(self.se) + [None],
                          list(z) + [None], p + [None])

    def linear_score(self) -> Column:
        eta = F.lit(0.0)
        for b, e in zip(self.beta, self.design.exprs):
            eta = eta + F.lit(float(b)) * e
        return eta


def _pick(values_by_g, g: Column) -> Column:
    """Per-grid-point literal: element g (0-based) of a literal array."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values_by_g]), g + 1)


def _softplus(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def _fit_grid(coll: DataFrame, cluster: str, p: int, sigmas, beta0, iters: int = 100, tol: float = 1e-8):
    spark = coll.sparkSession
    ensure_checkpoint_dir(spark)
    G = len(sigmas)
    betas = [np.array(beta0, dtype=float) for _ in range(G)]
    gidx = F.explode(F.sequence(F.lit(0), F.lit(G - 1))).alias("g")
    clusters = coll.select(cluster).distinct()
    bt = clusters.select(cluster, gidx).withColumn("b", F.lit(0.0)).checkpoint(eager=True)
    x = [F.col(f"x{i}") for i in range(p)]
    pairs = upper_pairs(p)
    per = None
    for _ in range(iters):
        g = F.col("g")
        inv_s2 = _pick([1.0 / (s * s) for s in sigmas], g)
        eta = F.col("b")
        for k in range(p):
            eta = eta + _pick([bb[k] for bb in betas], g) * x[k]
        rows = coll.join(bt, cluster)
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        wv = F.col("m") * mu * (F.lit(1.0) - mu)
        r = F.col("s") - F.col("m") * mu
        aggs = [F.first("b").alias("b"), F.first(inv_s2).alias("inv_s2"),
                (F.sum(r) - F.first("b") * F.first(inv_s2)).alias("gb"),
                (F.sum(wv) + F.first(inv_s2)).alias("hbb"),
                (F.sum(F.col("s") * eta - F.col("m") * _softplus(eta))
                 - F.first("b") * F.first("b") * F.first(inv_s2) / F.lit(2.0)).alias("llj")]
        aggs += [F.sum(r * x[k]).alias(f"gB{k}") for k in range(p)]
        aggs += [F.sum(wv * x[k]).alias(f"hBb{k}") for k in range(p)]
        aggs += [F.sum(wv * x[a] * x[b]).alias(f"hBB{a}_{b}") for a, b in pairs]
        # third-derivative sums for the gradient of -1/2 log h_j (Laplace term)
        w3 = wv * (F.lit(1.0) - F.lit(2.0) * mu)
        aggs += [F.sum(w3).alias("t0")] + [F.sum(w3 * x[k]).alias(f"t1_{k}") for k in range(p)]
        per = rows.groupBy("g", cluster).agg(*aggs).checkpoint(eager=True)
        hbb = F.col("hbb")
        sch = [F.sum(F.col(f"hBB{a}_{b}") - F.col(f"hBb{a}") * F.col(f"hBb{b}") / hbb) for a, b in pairs]
        # Newton right-hand side: penalised score after eliminating b, plus
        # d/dbeta of -1/2 log h_j with b following its conditional mode
        # (db_j/dbeta = -hBb/hbb), so the fixed point maximises the Laplace
        # likelihood in beta, not only the penalised likelihood
        rhs = [F.sum(F.col(f"gB{k}") - F.col(f"hBb{k}") * F.col("gb") / hbb
                     - F.lit(0.5) / hbb * (F.col(f"t1_{k}") - F.col("t0") * F.col(f"hBb{k}") / hbb))
               for k in range(p)]
        res = per.groupBy("g").agg(*[e.alias(f"S{i}") for i, e in enumerate(sch)],
                                   *[e.alias(f"R{k}") for k, e in enumerate(rhs)]).collect()
        steps = [np.zeros(p) for _ in range(G)]
        for row in res:
            s_mat = sym_from_upper([row[f"S{i}"] for i in range(len(pairs))], p)
            steps[row["g"]] = solve_sym(s_mat, np.array([row[f"R{k}"] for k in range(p)]))
        db = F.col("gb")
        for k in range(p):
            db = db - F.col(f"hBb{k}") * _pick([st[k] for st in steps], F.col("g"))
        bt = per.select(cluster, "g", (F.col("b") + db / hbb).alias("b")).checkpoint(eager=True)
        betas = [b + st for b, st in zip(betas, steps)]
        if max(float(np.max(np.abs(st))) for st in steps) < tol:
            break
    else:
        raise NotConverged(f"mixed logit model: no maximum after {iters} steps")
    # Laplace log-likelihood and Schur information at the final state
    lap = per.groupBy("g").agg(
        F.sum(F.col("llj") + F.lit(0.5) * F.ln(F.col("inv_s2")) - F.lit(0.5) * F.ln(F.col("hbb"))).alias("lap"),
        F.count(F.lit(1)).alias("k"),
        *[F.sum(F.col(f"hBB{a}_{b}") - F.col(f"hBb{a}") * F.col(f"hBb{b}") / F.col("hbb")).alias(f"S{i}")
          for i, (a, b) in enumerate(pairs)]).collect()
    out = {}
    for row in lap:
        g = row["g"]
        s_mat = sym_from_upper([row[f"S{i}"] for i in range(len(pairs))], p)
        out[g] = (float(row["lap"]), betas[g], inv_sym(s_mat), int(row["k"]),
                  bt.where(F.col("g") == g).select(cluster, "b"))
    return out


def fit_glmm_logit(df: DataFrame, y: str, success: str, terms, cluster: str,
                   design: Design | None = None, rounds: int = 2, grid: int = 8) -> MixedLogitFit:
    """Random-intercept logistic regression of ``y == success``."""
    from .glm import binomial_newton
    design = design or build_design(df, terms, True)
    p = design.p
    rows = complete_rows(df.where(F.col(cluster).isNotNull()), design, extra=[y])
    xf = rows.select(cluster, *[e.alias(f"x{i}") for i, e in enumerate(design.exprs)],
                     (F.col(y) == F.lit(success)).cast("double").alias("yy"))
    coll = collapse(xf, [cluster] + [f"x{i}" for i in range(p)],
                    {"s": F.sum("yy"), "m": F.count(F.lit(1)).cast("double")})
    beta0, cov0, ll0, n, _ = binomial_newton(coll, p, F.col("s"), F.col("m"))
    lo, hi = -3.0, 1.0
    evals = {}
    left = rounds
    while left:
        sig = [10.0 ** v for v in np.linspace(lo, hi, grid)]
        res = _fit_grid(coll, cluster, p, sig, beta0)
        for gi, v in res.items():
            evals[sig[gi]] = v
        best = max(evals, key=lambda s: evals[s][0])
        step = (hi - lo) / (grid - 1)
        if best == max(evals):  # the maximum lies beyond the largest sigma tried: look further up
            lo, hi = hi, hi + 2.0
            continue
        lo, hi = math.log10(best) - step, math.log10(best) + step
        left -= 1
        if best == min(evals) and evals[best][0] <= ll0 + 1e-6 * (abs(ll0) + 1.0):
            # no variance between clusters: the plain model is the fit
            return MixedLogitFit(design, beta0, cov0, 0.0, ll0, n, evals[best][3], None, cluster)
    best = max(evals, key=lambda s: evals[s][0])
    # refine: vertex of the parabola through the best grid point and its two
    # neighbours in log(sigma); one more fit there, kept if its likelihood is higher
    xs = sorted(evals)
    i = xs.index(best)
    if 0 < i < len(xs) - 1:
        (x0, x1, x2) = (math.log(xs[i - 1]), math.log(xs[i]), math.log(xs[i + 1]))
        (y0, y1, y2) = (evals[xs[i - 1]][0], evals[xs[i]][0], evals[xs[i + 1]][0])
        den = (x0 - x1) * (x0 - x2) * (x1 - x2)
        a = (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / den
        b = (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / den
        if a < 0:
            xv = -b / (2 * a)
            if x0 < xv < x2:
                sv = math.exp(xv)
                res = _fit_grid(coll, cluster, p, [sv], evals[best][1])
                evals[sv] = res[0]
                best = max(evals, key=lambda s: evals[s][0])
    lap, beta, cov, k, modes = evals[best]
    return MixedLogitFit(design, beta, cov, best, lap, n, k, modes, cluster)
