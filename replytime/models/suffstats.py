"""One-pass sufficient statistics and the collapse used by iterative fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .design import sym_from_upper, upper_pairs


def agg_vector(df: DataFrame, exprs: list) -> np.ndarray:
    """Evaluate many aggregate expressions in ONE Spark job; one row comes back.

    Expressions may be Columns or SQL text; text costs one JVM call per
    expression instead of one per operator, which matters for the hundreds of
    sums of a Hessian.
    """
    cols = [(F.expr(e) if isinstance(e, str) else e).alias(f"a{i}") for i, e in enumerate(exprs)]
    row = df.agg(*cols).first()
    return np.array([np.nan if v is None else float(v) for v in row], dtype=float)


def gram(df: DataFrame, p: int, y: str | None = None, w: str | None = None):
    """X'WX, X'Wy, y'Wy, sum W and n over columns x0..x{p-1} in one pass.

    ``y`` and ``w`` are column names (w defaults to 1).
    """
    w = w or "1.0D"
    exprs = [f"sum({w} * x{i} * x{j})" for i, j in upper_pairs(p)]
    exprs += [f"sum({w} * x{i} * {y})" for i in range(p)] if y is not None else []
    exprs += [f"sum({w} * {y} * {y})"] if y is not None else []
    exprs += [f"sum({w})", "count(1)"]
    v = agg_vector(df, exprs)
    k = p * (p + 1) // 2
    xtx = sym_from_upper(v[:k], p)
    if y is None:
        return xtx, None, None, v[k], int(v[k + 1])
    xty = v[k:k + p]
    return xtx, xty, v[k + p], v[k + p + 1], int(v[k + p + 2])


def collapse(df: DataFrame, keys: list[str], counts: dict[str, Column], checkpoint: bool = True) -> DataFrame:
    """Reduce rows to distinct key patterns with counts / sums.

    Iterative fits then pass over the collapsed table only.  It is
    checkpointed (reliable, to the shared ``spark.checkpoint.dir``) so every
    iteration reads it back instead of recomputing its lineage, and a lost
    executor does not send the fit back to the raw scan.
    """
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in counts.items()])
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        out = out.checkpoint(eager=True)
    return out


#: A design column whose part outside the columns before it is below this share of its sum of squares is aliased.
ALIASED = 1e-11


def independent(g: np.ndarray, tol: float = ALIASED) -> list[int]:
    """Numbers of the design columns that are no linear combination of those before them, from their Gram matrix.

    Cholesky in the order of the columns: one whose remaining pivot is below ``tol`` of its own sum of squares
    is left out, so of aliased terms the first stays.
    """
    kept: list[int] = []
    rows = np.zeros((0, g.shape[0]))
    for j in range(g.shape[0]):
        rest = g[j] - rows[:, j] @ rows
        if g[j, j] > 0 and rest[j] > tol * g[j, j]:
            kept.append(j)
            rows = np.vstack([rows, rest / np.sqrt(rest[j])])
    return kept


def expanded(kept: list[int], p: int, beta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of all p columns; those of aliased columns are NaN."""
    b, v = np.full(p, np.nan), np.full((p, p), np.nan)
    b[kept] = beta
    v[np.ix_(kept, kept)] = cov
    return b, v


class NotConverged(RuntimeError):
    """An iterative fit found no maximum (separated data, a singular design, too few steps)."""


def newton(evaluate, theta, what: str, tol: float = 1e-9, max_iter: int = 100, valid=lambda t: True):
    """Maximise a log-likelihood: ``evaluate(theta) -> (gradient, Hessian, value)``, one Spark job a call.

    A full Newton step is tried first and halved while the value drops, is not
    a number, or ``valid`` refuses the point.  Returns theta, gradient, Hessian,
    value and the number of steps; raises NotConverged instead of returning a
    point that is not a maximum.
    """
    theta = np.asarray(theta, dtype=float)
    g, h, value = evaluate(theta)
    if not np.isfinite(value):
        raise NotConverged(f"{what}: the likelihood at the start is not a number")
    for it in range(1, max_iter + 1):
        step = -solve_sym(h, g)
        lam, slack = 1.0, 1e-12 * (abs(value) + 1.0)
        while True:
            cand = theta + lam * step
            if valid(cand):
                g_new, h_new, new = evaluate(cand)
                if np.isfinite(new) and new >= value - slack:
                    break
            lam /= 2.0
            if lam < 1e-12:
                raise NotConverged(f"{what}: no step raises the likelihood")
        small = np.max(np.abs(lam * step), initial=0.0) < 1e-7 * (1.0 + np.max(np.abs(cand), initial=0.0))
        done = abs(new - value) < tol * (abs(value) + 1.0) and small
        theta, g, h, value = cand, g_new, h_new, new
        if done:
            return theta, g, h, value, it
    raise NotConverged(f"{what}: no maximum after {max_iter} steps")


def solve_sym(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a small symmetric system (least squares if singular)."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def inv_sym(a: np.ndarray) -> np.ndarray:
    """Inverse of a small symmetric matrix (pseudo-inverse if singular)."""
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)
