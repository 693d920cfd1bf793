"""Null-faithful Column expressions.

Every conditional here keeps the missing-value rule of vectorised ``ifelse``:
a NULL condition gives a NULL result (a plain CASE WHEN would fall through to
the ELSE branch).  All functions return ``Column`` objects, so they stay
inside whole-stage code generation.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: SPSS date-times count seconds from 1582-10-14; the Unix epoch
# is 141,428 days later.
SPSS_EPOCH_OFFSET_DAYS = 141428
SECONDS_PER_DAY = 86400
SPSS_EPOCH_OFFSET_SECONDS = SPSS_EPOCH_OFFSET_DAYS * SECONDS_PER_DAY


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def r_ifelse(cond, yes, no) -> Column:
    """``ifelse(cond, yes, no)``: NULL when ``cond`` is NULL, else yes/no."""
    cond = _c(cond)
    return F.when(cond.isNull(), F.lit(None)).when(cond, _c(yes)).otherwise(_c(no))


def r_switch(col, cases: dict, default=None) -> Column:
    """Nested ``ifelse`` on equality tests of one column: NULL input gives NULL."""
    c = _c(col)
    expr = F.when(c.isNull(), F.lit(None))
    for k, v in cases.items():
        expr = expr.when(c == F.lit(k), _c(v))
    return expr.otherwise(_c(default) if default is not None else F.lit(None))


def r_case(*branches, default=None) -> Column:
    """Nested ``ifelse``: ``r_case((c1, v1), (c2, v2), default=v)``.

    Evaluated in order; the first NULL condition yields NULL and stops,
    a FALSE one moves to the next branch.  Emitted as ONE flat CASE WHEN so
    generated code stays small when the expression is inlined downstream.
    """
    expr = None
    for cond, val in branches:
        cond = _c(cond)
        expr = (F.when(cond.isNull(), F.lit(None)) if expr is None
                else expr.when(cond.isNull(), F.lit(None)))
        expr = expr.when(cond, _c(val))
    return expr.otherwise(_c(default) if default is not None else F.lit(None))


def spss_to_date(col) -> Column:
    """SPSS seconds to a calendar date (time of day dropped, zone independent)."""
    secs = _c(col)
    days = F.floor((secs - F.lit(float(SPSS_EPOCH_OFFSET_SECONDS))) / F.lit(float(SECONDS_PER_DAY)))
    return F.date_from_unix_date(days.cast("int"))


def reply_days(end, start) -> Column:
    """Whole days from ``start`` to ``end`` (NULL if either is NULL)."""
    return F.datediff(_c(end), _c(start))


def nonpositive_to_null(col, bound: int = 0, inclusive: bool = True) -> Column:
    """Times at or below ``bound`` (or strictly below when not inclusive) become NULL."""
    c = _c(col)
    bad = c <= F.lit(bound) if inclusive else c < F.lit(bound)
    return r_ifelse(bad, F.lit(None), c)


def safe_ln(col) -> Column:
    """Natural log defined only for positive input (NULL otherwise)."""
    c = _c(col)
    return F.when(c > 0, F.ln(c))


def los_transform(col, floor_at_one: bool = True) -> Column:
    """Log length of stay; optionally floor LOS at one day first."""
    c = _c(col).cast("double")
    if floor_at_one:
        c = r_ifelse(c < 1, F.lit(1.0), c)
    return safe_ln(c)


def floor_los(col) -> Column:
    """LOS floored at one day (NULL stays NULL)."""
    c = _c(col)
    return r_ifelse(c < 1, F.lit(1), c)


def inv_logit(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Logistic function scaled to ``[lo, hi]``; stable for large ``|x|``.

    NULL in gives NULL out; +inf gives 1 (scaled), as the guarded original.
    """
    v = _c(x).cast("double")
    p = F.when(v >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-v))).otherwise(
        F.exp(v) / (F.lit(1.0) + F.exp(v)))
    return p * F.lit(float(hi - lo)) + F.lit(float(lo))


def composite_key(*cols, sep: str = ".") -> Column:
    """The parts joined by ``sep``; NULL if any part is NULL."""
    parts = [_c(c).cast("string") for c in cols]
    joined = [x for p in parts for x in (F.lit(sep), p)][1:]
    return F.concat(*joined)
