"""Binomial GLM (logit link) by Newton-Raphson over collapsed counts.

Rows are reduced once to distinct (design pattern) with successes and trials;
every Newton step is then ONE aggregate over that table (gradient, Hessian and
log-likelihood together).  With few distinct patterns (factors, whole-day
covariates) the table is tiny; with many it degrades to one pass per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_sf
from .design import (Design, build_design, coef_frame, complete_rows, linear_predictor, linear_score, sym_from_upper,
                     upper_pairs)
from .suffstats import agg_vector, collapse, expanded, gram, independent, inv_sym, newton


@dataclass
class LogitFit:
    """Fitted logistic regression."""
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    deviance: float
    n: int
    iterations: int
    success: str

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))

    def table(self, spark) -> DataFrame:
        z = self.beta / self.se
        p = [2.0 * norm_sf(abs(float(v))) for v in z]
        return coef_frame(spark, self.design.names, self.beta, self.se, z, p)

    def linear_score(self) -> Column:
        return linear_score(self.design, self.beta)


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def binomial_newton(coll: DataFrame, p: int, s: Column, m: Column, offset: Column | None = None,
                    beta0=None, tol: float = 1e-10, max_iter: int = 100):
    """Newton-Raphson for the logit model on collapsed rows (x0.., s successes, m trials)."""
    pairs = upper_pairs(p)
    x = [F.col(f"x{i}") for i in range(p)]
    trials = 0

    def evaluate(beta):
        nonlocal trials
        eta = linear_predictor(beta, p, offset)
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        # per-row weight, residual and log-likelihood once, below the aggregate
        base = coll.select(*x, (m * mu * (F.lit(1.0) - mu)).alias("_w"), (s - m * mu).alias("_r"),
                           (s * eta - m * _softplus(eta)).alias("_ll"), m.alias("_m"))
        exprs = [f"sum(_r * x{i})" for i in range(p)]
        exprs += [f"sum(_w * x{i} * x{j})" for i, j in pairs]
        v = agg_vector(base, [*exprs, "sum(_m)", "sum(_ll)"])
        trials = int(v[-2])
        return v[:p], -sym_from_upper(v[p:p + len(pairs)], p), float(v[-1])

    start = np.zeros(p) if beta0 is None else np.array(beta0, dtype=float)
    beta, _, h, loglik, it = newton(evaluate, start, "logit model", tol, max_iter)
    return beta, inv_sym(-h), loglik, trials, it


def fit_logit(df: DataFrame, y: str, success: str, terms, intercept: bool = True,
              design: Design | None = None, weights: str | None = None) -> LogitFit:
    """Logistic regression of ``y == success`` (the non-reference response level)."""
    design = design or build_design(df, terms, intercept)
    p = design.p
    rows = complete_rows(df, design, extra=[y] + ([weights] if weights else []))
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    xf = rows.select(*[e.alias(f"x{i}") for i, e in enumerate(design.exprs)],
                     (F.col(y) == F.lit(success)).cast("double").alias("y"), w.alias("w"))
    coll = collapse(xf, [f"x{i}" for i in range(p)],
                    {"s": F.sum(F.col("w") * F.col("y")), "m": F.sum("w")})
    # aliased columns (combinations of earlier ones) leave the fit; their coefficients are NaN
    kept = independent(gram(coll, p, w="m")[0])
    inner = coll.select(*[F.col(f"x{j}").alias(f"x{i}") for i, j in enumerate(kept)], "s", "m")
    beta, cov, ll, n, it = binomial_newton(inner, len(kept), F.col("s"), F.col("m"))
    beta, cov = expanded(kept, p, beta, cov)
    return LogitFit(design, beta, cov, ll, -2.0 * ll, n, it, success)


def odds_ratio_rows(fit: LogitFit):
    """exp(b) with delta-method standard errors."""
    orr = np.exp(fit.beta)
    return orr, orr * fit.se
