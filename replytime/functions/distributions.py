"""Tail probabilities for test statistics (normal, t, chi-square, F).

SciPy is not available, so the regularized incomplete gamma and beta
functions are evaluated with the classic series / continued-fraction
expansions.  They are applied to one-row (or few-row) results through
Arrow-batched pandas UDFs, never to row data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_MAXIT = 10000


def _gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    ap = a
    for _ in range(_MAXIT):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAXIT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAXIT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_cf(b, a, 1.0 - x) / b


def norm_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square with ``df`` degrees of freedom (NaN when df <= 0)."""
    if not df > 0 or math.isnan(x):
        return float("nan")
    return gamma_q(df / 2.0, x / 2.0)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic (NaN when df <= 0)."""
    if not df > 0 or math.isnan(t):
        return float("nan")
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of F(d1, d2) (NaN when a degree of freedom is <= 0)."""
    if not (d1 > 0 and d2 > 0) or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _vec(fn, *series):
    """Apply ``fn`` row by row; missing input or an undefined result gives NULL."""
    out = []
    for vals in zip(*series):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
            out.append(None)
        else:
            r = fn(*[float(v) for v in vals])
            out.append(None if math.isnan(r) else r)
    return pd.Series(pd.array(out, dtype="Float64"))


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, df)


@F.pandas_udf(T.DoubleType())
def _t_sf2_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_sf2, t, df)


@F.pandas_udf(T.DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


def chi2_pvalue(stat: Column, df: Column) -> Column:
    """Column: chi-square upper-tail probability (one-row use)."""
    return _chi2_sf_udf(stat.cast("double"), df.cast("double"))


def t_pvalue(t: Column, df: Column) -> Column:
    """Column: two-sided t p-value (one-row use)."""
    return _t_sf2_udf(t.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    """Column: F-test p-value (one-row use)."""
    return _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))
