"""Design matrices as Column expressions (treatment coding, first level = reference).

A model never materialises a row-level matrix on the driver: the design is a
list of Spark Column expressions, and every fit aggregates over them.
Factor levels come from the caller (the level dictionary) or, when not
given, from the data in alphabetical order - the order a CSV round trip
gives in the source study.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels that a factor without given levels may have: the normal equations are solved on the driver.
MOST_LEVELS = 2000


@dataclass(frozen=True)
class Factor:
    """Categorical term; ``levels[0]`` is the reference level."""
    col: str
    levels: tuple | None = None  # first level is the reference


@dataclass(frozen=True)
class Numeric:
    """Numeric term, optionally logged (positive values only)."""
    col: str
    log: bool = False


@dataclass
class Design:
    """Coefficient names and their Column expressions."""
    names: list[str]            # coefficient names, intercept first when present
    exprs: list[Column]         # one double Column per coefficient
    used: list[str]             # source columns (complete cases are taken on these)
    factors: dict = field(default_factory=dict)  # col -> levels
    terms: tuple = ()
    intercept: bool = True

    @property
    def p(self) -> int:
        return len(self.names)


def discover_levels(df: DataFrame, col: str) -> tuple:
    """Distinct non-null values, sorted: one coefficient each.

    A column with more than ``MOST_LEVELS`` of them (an id given as a factor by mistake) is refused.
    """
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{col} has more than {MOST_LEVELS} levels; give them, or use another term")
    return tuple(sorted(r[0] for r in found))


def build_design(df: DataFrame, terms, intercept: bool = True) -> Design:
    """Design of ``terms`` (treatment contrasts), with an intercept column when asked."""
    names, exprs, used, factors = [], [], [], {}
    if intercept:
        names.append("(Intercept)")
        exprs.append(F.lit(1.0))
    for t in terms:
        if isinstance(t, str):
            t = Numeric(t)
        if isinstance(t, Factor):
            lv = t.levels if t.levels is not None else discover_levels(df, t.col)
            factors[t.col] = tuple(lv)
            # treatment contrasts: the reference (first) level is always dropped, also
            # in models whose intercept is absorbed (thresholds, baseline hazard)
            for lvl in lv[1:]:
                names.append(f"{t.col}{lvl}")
                exprs.append(F.when(F.col(t.col) == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)))
            used.append(t.col)
        else:
            x = F.col(t.col).cast("double")
            if t.log:
                names.append(f"log({t.col})")
                exprs.append(F.when(x > 0, F.ln(x)))
            else:
                names.append(t.col)
                exprs.append(x)
            used.append(t.col)
    d = Design(names, exprs, used, factors, tuple(terms), intercept)
    return d


def complete_rows(df: DataFrame, design: Design, extra=()) -> DataFrame:
    """Rows with every model column present and every factor value a known level."""
    cond = F.lit(True)
    for c in list(design.used) + list(extra):
        cond = cond & F.col(c).isNotNull()
    for c, lv in design.factors.items():
        cond = cond & F.col(c).isin(*lv)
    for t in design.terms:
        if isinstance(t, Numeric) and t.log:
            cond = cond & (F.col(t.col) > 0)
    return df.where(cond)


def design_frame(df: DataFrame, design: Design, keep=()) -> DataFrame:
    """Rows with the design as columns ``x0..x{p-1}`` (plus kept columns)."""
    return complete_rows(df, design).select(*keep, *[e.alias(f"x{i}") for i, e in enumerate(design.exprs)])



def linear_predictor(beta, p: int, offset: Column | None = None) -> Column:
    """sum_j beta_j * x_j as one Column (coefficients are literals; aliased ones, NaN, add nothing)."""
    eta = F.lit(0.0)
    for j in range(p):
        if not np.isnan(beta[j]):
            eta = eta + F.lit(float(beta[j])) * F.col(f"x{j}")
    return eta if offset is None else eta + offset


def linear_score(design: Design, beta) -> Column:
    """The linear predictor over a table with the model's own columns; aliased coefficients add nothing."""
    eta = F.lit(0.0)
    for b, e in zip(beta, design.exprs):
        if not np.isnan(b):
            eta = eta + F.lit(float(b)) * e
    return eta


def sym_from_upper(vals, p: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle listed row by row."""
    m = np.zeros((p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = vals[k]
            k += 1
    return m


def upper_pairs(p: int):
    """Index pairs (i <= j) of a p x p upper triangle."""
    return [(i, j) for i in range(p) for j in range(i, p)]


COEF_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("estimate", T.DoubleType(), True),
    T.StructField("std_error", T.DoubleType(), True),
    T.StructField("statistic", T.DoubleType(), True),
    T.StructField("p_value", T.DoubleType(), True),
])


def coef_frame(spark: SparkSession, names, est, se, stat, pval) -> DataFrame:
    """Tidy coefficient table (term, estimate, std_error, statistic, p_value)."""
    rows = [(n, _f(b), _f(s), _f(z), _f(q)) for n, b, s, z, q in zip(names, est, se, stat, pval)]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def _f(v):
    if v is None:
        return None
    v = float(v)
    return None if np.isnan(v) else v


def profile_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Small table of covariate profiles for prediction (given by the caller)."""
    cols = list(rows[0].keys())
    fields = []
    for c in cols:
        v = rows[0][c]
        t = T.DoubleType() if isinstance(v, float) else (T.LongType() if isinstance(v, int) else T.StringType())
        fields.append(T.StructField(c, t, True))
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], T.StructType(fields))
