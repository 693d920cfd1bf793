"""Ordinary and weighted least squares from one Gram pass plus one residual pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_sf2
from .design import Design, build_design, coef_frame, complete_rows, linear_predictor, linear_score
from .suffstats import agg_vector, expanded, gram, independent, inv_sym, solve_sym


@dataclass
class LinearFit:
    """Fitted (weighted) least squares; coefficients of aliased terms are NaN."""
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    sigma: float
    df_resid: int
    n: int
    r2: float
    rss: float
    log_y: bool = False

    @property
    def se(self):
        return np.sqrt(np.diag(self.cov))

    def table(self, spark) -> DataFrame:
        t = self.beta / self.se
        p = [t_sf2(float(v), self.df_resid) for v in t]
        return coef_frame(spark, self.design.names, self.beta, self.se, t, p)

    def predict(self, df: DataFrame, name: str = "fit") -> DataFrame:
        """Linear score of any DataFrame with the model's columns (a Column sum)."""
        return df.withColumn(name, linear_score(self.design, self.beta))


def model_frame(df: DataFrame, design: Design, y: str, log_y: bool = False, weights: str | None = None,
                keep=()) -> DataFrame:
    """Complete rows with design columns ``x0..``, response ``y`` and weight ``w``."""
    rows = complete_rows(df, design, extra=[y] + ([weights] if weights else []))
    yv = F.col(y).cast("double")
    if log_y:
        rows = rows.where(yv > 0)
        yv = F.ln(yv)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    return rows.select(*keep, *[e.alias(f"x{i}") for i, e in enumerate(design.exprs)], yv.alias("y"), w.alias("w"))


def fit_lm(df: DataFrame, y: str, terms, weights: str | None = None, log_y: bool = False,
           intercept: bool = True, design: Design | None = None) -> LinearFit:
    """Least squares of ``y`` (or ``log y``) on the design.

    One aggregate gives X'WX and X'Wy, a second the residual and total sums of
    squares around the fit.  A column that is a linear combination of earlier ones is aliased: its coefficient,
    error and covariances are NaN (NULL in the table), and the fit is that without it.
    """
    design = design or build_design(df, terms, intercept)
    p = design.p
    mf = model_frame(df, design, y, log_y, weights)
    xtx, xty, yty, sw, n = gram(mf, p, "y", "w")
    kept = independent(xtx)
    inner = xtx[np.ix_(kept, kept)]
    beta, inverse = expanded(kept, p, solve_sym(inner, xty[kept]), inv_sym(inner))
    ybar = (xty[0] / sw) if intercept else 0.0
    # a second pass sums the residuals themselves: y'Wy - b'X'Wy would lose the digits that cancel
    res = F.col("y") - linear_predictor(beta, p)
    dev = F.col("y") - F.lit(float(ybar))
    rss, tss = agg_vector(mf, [F.sum(F.col("w") * res * res), F.sum(F.col("w") * dev * dev)])
    df_resid = n - len(kept)
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    cov = sigma2 * inverse
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    return LinearFit(design, beta, cov, float(np.sqrt(sigma2)), df_resid, n, r2, rss, log_y)
