"""Proportional-odds (cumulative logit) model: logit P(Y <= k) = zeta_k - x'beta.

Newton-Raphson over rows collapsed to (pattern, category) counts; the
gradient, Hessian and log-likelihood of each step are one Spark aggregate.
The thresholds of a row's category are picked from literal arrays, so the
per-row work is a handful of JVM-side expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_sf
from .design import Design, build_design, coef_frame, complete_rows, linear_predictor, sym_from_upper, upper_pairs
from .suffstats import agg_vector, collapse, inv_sym, newton

BIG = 1e6  # stands in for +-infinity at the outer thresholds (logistic saturates far earlier)


@dataclass
class OrdinalFit:
    """Fitted proportional-odds model: slopes and thresholds."""
    design: Design           # no intercept
    levels: tuple            # ordered response levels, lowest first
    beta: np.ndarray
    zeta: np.ndarray         # K-1 increasing thresholds
    cov: np.ndarray          # over (beta, zeta)
    loglik: float
    n: int
    iterations: int

    @property
    def names(self):
        return list(self.design.names) + [f"{a}|{b}" for a, b in zip(self.levels[:-1], self.levels[1:])]

    def table(self, spark) -> DataFrame:
        theta = np.append(self.beta, self.zeta)
        se = np.sqrt(np.diag(self.cov))
        z = theta / se
        p = [2.0 * norm_sf(abs(float(v))) for v in z]
        return coef_frame(spark, self.names, theta, se, z, p)

    def linear_score(self) -> Column:
        eta = F.lit(0.0)
        for b, e in zip(self.beta, self.design.exprs):
            eta = eta + F.lit(float(b)) * e
        return eta

    def prob_columns(self, prefix: str = "p_") -> list[str]:
        """Output names of the class probabilities: ``p_<level>`` (spaces as ``_``)."""
        return [prefix + "".join(ch if ch.isalnum() else "_" for ch in str(lv)).strip("_") for lv in self.levels]

    def class_probabilities(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        """P(Y = level) for every level (``p_<level>``) and the most likely level, as Columns."""
        eta = self.linear_score()
        cdf = [F.lit(0.0)] + [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(z)) - eta))) for z in self.zeta] \
            + [F.lit(1.0)]
        probs = [cdf[k + 1] - cdf[k] for k in range(len(self.levels))]
        names = self.prob_columns(prefix)
        out = df.withColumns(dict(zip(names, probs)))
        arr = F.array(*[F.col(n) for n in names])
        lv = F.array(*[F.lit(x) for x in self.levels])
        best = F.array_position(arr, F.array_max(arr))
        return out.withColumn("predicted", F.element_at(lv, best.cast("int")))


def _logistic(u: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-u))


def _softplus(u: Column) -> Column:
    """log(1 + e^u) without overflow."""
    return F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))


def _pieces(coll: DataFrame, beta, zeta, p: int, k_levels: int, want_hess: bool = True):
    eta = linear_predictor(beta, p)
    zext = [-BIG] + [float(z) for z in zeta] + [BIG]
    zarr = F.array(*[F.lit(z) for z in zext])
    k = F.col("k")  # 1..K
    a = F.element_at(zarr, k + 1) - eta     # upper threshold of the category
    b = F.element_at(zarr, k) - eta         # lower threshold
    top = k == k_levels
    bottom = k == 1
    one, zero = F.lit(1.0), F.lit(0.0)
    # P = F(a) (1 - F(b)) (1 - e^(b-a)): every factor and every ratio below stays finite far in the tails
    gap = F.when(top | bottom, one).otherwise(-F.expm1(b - a))
    fa_cdf, fb_cdf = _logistic(a), _logistic(b)
    # ua = f(a) / P and ub = f(b) / P; at the outer thresholds the densities are 0
    ua = F.when(top, zero).when(bottom, one - fa_cdf).otherwise(F.exp(_softplus(b) - _softplus(a)) / gap)
    ub = F.when(bottom, zero).when(top, fb_cdf).otherwise(F.exp(_softplus(-a) - _softplus(-b)) / gap)
    va = ua * (one - F.lit(2.0) * fa_cdf)
    vb = ub * (one - F.lit(2.0) * fb_cdf)
    lnp = F.when(top, zero).otherwise(-_softplus(-a)) + F.when(bottom, zero).otherwise(-_softplus(b)) + F.ln(gap)
    # per-row pieces computed once in a projection; the aggregate then only
    # combines columns (small generated code, no re-evaluation per entry)
    coll = coll.select("w", "k", *[F.col(f"x{j}") for j in range(p)], ua.alias("ua"), ub.alias("ub"),
                       va.alias("va"), vb.alias("vb"), lnp.alias("lnp"))
    q = p + k_levels - 1
    # SQL text: one JVM call per sum
    exprs = [f"sum(w * (ub - ua) * x{j})" for j in range(p)]
    for m in range(1, k_levels):  # threshold zeta_m: upper for k == m, lower for k == m + 1
        exprs.append(f"sum(w * (CASE WHEN k = {m} THEN ua ELSE 0D END - CASE WHEN k = {m + 1} THEN ub ELSE 0D END))")
    if want_hess:
        for i, j in upper_pairs(q):
            if i < p and j < p:
                e = f"sum(w * (va - vb - (ua - ub) * (ua - ub)) * x{i} * x{j})"
            elif i < p:
                m = j - p + 1
                e = (f"sum(w * x{i} * (CASE WHEN k = {m} THEN (ua - ub) * ua - va ELSE 0D END"
                     f" + CASE WHEN k = {m + 1} THEN vb - (ua - ub) * ub ELSE 0D END))")
            else:
                m1, m2 = i - p + 1, j - p + 1
                if m1 == m2:
                    e = (f"sum(w * (CASE WHEN k = {m1} THEN va - ua * ua ELSE 0D END"
                         f" + CASE WHEN k = {m1 + 1} THEN -vb - ub * ub ELSE 0D END))")
                elif m2 == m1 + 1:
                    e = f"sum(w * CASE WHEN k = {m2} THEN ua * ub ELSE 0D END)"
                else:
                    e = "sum(0D)"
            exprs.append(e)
    # a row whose term is not a number must not leave the sum unseen
    exprs.append("CASE WHEN count_if(lnp IS NULL) = 0 THEN sum(w * lnp) END")
    v = agg_vector(coll, exprs)
    g = v[:q]
    h = sym_from_upper(v[q:q + q * (q + 1) // 2], q) if want_hess else None
    return g, h, float(v[-1])


def fit_ordinal(df: DataFrame, y: str, levels, terms, design: Design | None = None, tol: float = 1e-9,
             max_iter: int = 100, count: str | None = None) -> OrdinalFit:
    """Proportional-odds logistic regression of the ordered response ``y``.

    ``count`` names a column with the number of rows that a row stands for (a table collapsed before).
    """
    design = design or build_design(df, terms, intercept=False)
    p = design.p
    rows = complete_rows(df, design, extra=[y]).where(F.col(y).isin(*levels))
    kk = len(levels)
    k = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(y)).cast("int")
    xf = rows.select(*[e.alias(f"x{i}") for i, e in enumerate(design.exprs)], k.alias("k"), *([count] if count else []))
    coll = collapse(xf, [f"x{i}" for i in range(p)] + ["k"],
                    {"w": F.sum(count) if count else F.count(F.lit(1)).cast("double")})
    cnt = agg_vector(coll, [F.sum(F.when(F.col("k") == m, F.col("w")).otherwise(0.0)) for m in range(1, kk + 1)])
    if np.any(cnt == 0):
        # levels with no observation are dropped before numbering (as an unused
        # factor level is): renumber the categories on the small collapsed table
        keep = [m + 1 for m in range(kk) if cnt[m] > 0]
        levels = tuple(levels[m - 1] for m in keep)
        new_k = F.array_position(F.array(*[F.lit(m) for m in keep]), F.col("k")).cast("int")
        coll = coll.withColumn("k", new_k)
        cnt = cnt[cnt > 0]
        kk = len(levels)
    if kk < 3:
        raise ValueError(f"{y}: an ordinal model needs at least 3 observed levels, got {levels}")
    # start: marginal cumulative logits, beta = 0
    cum = np.cumsum(cnt)[:-1] / cnt.sum()
    zeta = np.log(cum / (1.0 - cum))
    beta = np.zeros(p)
    theta, _, h, ll, it = newton(lambda t: _pieces(coll, t[:p], t[p:], p, kk), np.append(beta, zeta),
                                 f"ordinal model of {y}", tol, max_iter, valid=lambda t: np.all(np.diff(t[p:]) > 0))
    beta, zeta = theta[:p], theta[p:]
    n = int(cnt.sum())
    return OrdinalFit(design, tuple(levels), beta, zeta, inv_sym(-h), ll, n, it)
