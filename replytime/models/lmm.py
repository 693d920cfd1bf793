"""Linear model with a random intercept per cluster, fitted by REML.

With V_j = sigma^2 (I + gamma 1 1') for cluster j (gamma = sigma_a^2 / sigma^2),
every quantity REML needs is a sum over clusters of closed forms in the
cluster's sufficient statistics n_j, X_j'1, X_j'X_j, X_j'y, 1'y and y'y:

    X'H^-1 X = sum_j X_j'X_j - w_j (X_j'1)(1'X_j),   w_j = gamma / (1 + gamma n_j)

So ONE ``groupBy(cluster)`` pass over the rows (partially aggregated before
the shuffle) gives a table with one row per cluster.  The REML criterion is
then profiled over log(gamma): each round evaluates a whole grid of gamma
values in one Spark job (``explode`` of the grid per cluster row, then
``groupBy(gamma)``); the grid is refined around the best value.  Only
p x p matrices per grid point reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_sf2
from .design import Design, build_design, coef_frame, sym_from_upper, upper_pairs
from ..session import ensure_checkpoint_dir
from .lm import model_frame
from .suffstats import inv_sym, solve_sym


@dataclass
class MixedFit:
    """Fitted random-intercept linear model (REML)."""
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    sigma: float           # residual sd
    sigma_a: float         # cluster intercept sd
    reml: float            # REML log-likelihood
    n: int
    n_groups: int

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))

    def table(self, spark) -> DataFrame:
        t = self.beta / self.se
        df_approx = max(self.n - len(self.beta), 1)
        p = [t_sf2(float(v), df_approx) for v in t]
        names = list(self.design.names) + ["sd(Intercept)", "sd(Residual)"]
        est = list(self.beta) + [self.sigma_a, self.sigma]
        se = list(self.se) + [None, None]
        st = list(t) + [None, None]
        pv = p + [None, None]
        return coef_frame(spark, names, est, se, st, pv)


def cluster_stats(mf: DataFrame, cluster: str, p: int) -> DataFrame:
    """One row per cluster: n, X'1, X'X (upper), X'y, 1'y, y'y."""
    x = [F.col(f"x{i}") for i in range(p)]
    y = F.col("y")
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    aggs += [F.sum(x[i]).alias(f"sx{i}") for i in range(p)]
    aggs += [F.sum(x[i] * y).alias(f"sxy{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"sxx{i}_{j}") for i, j in upper_pairs(p)]
    return mf.groupBy(cluster).agg(*aggs)


def _grid_sums(cs: DataFrame, gammas, p: int):
    """For each gamma: X'H^-1X, X'H^-1y, y'H^-1y, log|H| (one Spark job for the whole grid)."""
    g = F.explode(F.array(*[F.lit(float(v)) for v in gammas])).alias("gamma")
    t = cs.select("*", g)
    w = F.col("gamma") / (F.lit(1.0) + F.col("gamma") * F.col("n"))
    aggs = [F.sum(F.col(f"sxx{i}_{j}") - w * F.col(f"sx{i}") * F.col(f"sx{j}")).alias(f"A{i}_{j}")
            for i, j in upper_pairs(p)]
    aggs += [F.sum(F.col(f"sxy{i}") - w * F.col(f"sx{i}") * F.col("sy")).alias(f"b{i}") for i in range(p)]
    aggs += [F.sum(F.col("syy") - w * F.col("sy") * F.col("sy")).alias("c"),
             F.sum(F.log1p(F.col("gamma") * F.col("n"))).alias("logdet"),
             F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
    rows = t.groupBy("gamma").agg(*aggs).collect()
    out = {}
    for r in rows:
        a = sym_from_upper([r[f"A{i}_{j}"] for i, j in upper_pairs(p)], p)
        b = np.array([r[f"b{i}"] for i in range(p)])
        out[float(r["gamma"])] = (a, b, float(r["c"]), float(r["logdet"]), int(r["n"]), int(r["k"]))
    return out


def _reml(a, b, c, logdet, n, p):
    beta = solve_sym(a, b)
    rss = c - float(b @ beta)
    s2 = rss / (n - p)
    sign, ldx = np.linalg.slogdet(a)
    crit = -0.5 * ((n - p) * (1.0 + math.log(2.0 * math.pi * s2)) + logdet + ldx)
    return crit, beta, s2


def fit_lmm(df: DataFrame, y: str, terms, cluster: str, log_y: bool = False,
            design: Design | None = None, rounds: int = 4) -> MixedFit:
    """REML fit of y ~ terms + (1 | cluster)."""
    design = design or build_design(df, terms, True)
    p = design.p
    mf = model_frame(df.where(F.col(cluster).isNotNull()), design, y, log_y, keep=[cluster])
    ensure_checkpoint_dir(df.sparkSession)
    cs = cluster_stats(mf, cluster, p).checkpoint(eager=True)
    lo, hi, npts = -12.0, 4.0, 33
    best = None
    evals = {}
    for _ in range(rounds):
        grid = [10.0 ** v for v in np.linspace(lo, hi, npts)]
        sums = _grid_sums(cs, grid, p)
        for gam, (a, b, c, logdet, n, k) in sums.items():
            crit, beta, s2 = _reml(a, b, c, logdet, n, p)
            evals[gam] = (crit, beta, s2, a, n, k)
        best = max(evals, key=lambda gm: evals[gm][0])
        step = (hi - lo) / (npts - 1)
        centre = math.log10(best)
        lo, hi = centre - 2 * step, centre + 2 * step
    # last: vertex of the parabola through the best point and its neighbours in log gamma
    xs = sorted(evals)
    at = xs.index(best)
    if 0 < at < len(xs) - 1:
        x = [math.log10(v) for v in xs[at - 1:at + 2]]
        f = [evals[v][0] for v in xs[at - 1:at + 2]]
        c2, c1, _ = np.polyfit(np.array(x) - x[1], f, 2)
        shift = -c1 / (2 * c2) if c2 < 0 else 0.0
        if x[0] - x[1] < shift < x[2] - x[1]:
            vertex = 10.0 ** (x[1] + shift)
            a, b, c, logdet, n, k = next(iter(_grid_sums(cs, [vertex], p).values()))
            crit, beta, s2 = _reml(a, b, c, logdet, n, p)
            if crit >= evals[best][0]:
                best = vertex
                evals[best] = (crit, beta, s2, a, n, k)
    crit, beta, s2, a, n, k = evals[best]
    # below this ratio the criterion no longer tells it from zero: no variance between clusters
    sigma_a2 = 0.0 if best < 1e-9 else best * s2
    cov = s2 * inv_sym(a)
    return MixedFit(design, beta, cov, math.sqrt(s2), math.sqrt(sigma_a2), crit, n, k)
