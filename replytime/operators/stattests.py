"""Classical tests from sufficient statistics computed by Spark aggregates.

The statistic and degrees of freedom are Column expressions over a
one-row aggregate; only the tail probability goes through a pandas UDF
(one row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_pvalue, f_pvalue, t_pvalue
from .describe import group_moments


def chi_square_independence(df: DataFrame, a: str, b: str, p_value: bool = True) -> DataFrame:
    """Pearson chi-square test of independence for two categorical columns (NA dropped).

    Works on the observed cells only: an empty cell adds (0 - E)^2 / E = E,
    and the expected counts of all cells sum to N, so
    X^2 = sum_observed (O - E)^2 / E + (N - sum_observed E).
    No grid of level pairs is built.
    """
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = src.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    w_all = Window.partitionBy(F.lit(0))
    e = (F.sum("n").over(Window.partitionBy(a)).cast("double")
         * F.sum("n").over(Window.partitionBy(b)).cast("double")
         / F.sum("n").over(w_all).cast("double"))
    cells = cells.withColumn("_e", e)
    o = F.col("n").cast("double")
    one = cells.agg(
        (F.sum((o - F.col("_e")) * (o - F.col("_e")) / F.col("_e"))
         + (F.sum(o) - F.sum("_e"))).alias("statistic"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"),
        F.sum("n").alias("n"))
    if p_value:
        one = one.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("df")))
    return one


def welch_t_test(df: DataFrame, value: str, group: str, levels, p_value: bool = True) -> DataFrame:
    """Welch two-sample t test of ``value`` between two levels of ``group``.

    Difference is first level minus second, as the formula interface orders
    factor levels.
    """
    l1, l2 = levels
    x = F.col(value).cast("double")
    g = F.col(group)
    one = df.agg(
        F.count(F.when(g == l1, x)).alias("n1"), F.avg(F.when(g == l1, x)).alias("mean1"),
        F.var_samp(F.when(g == l1, x)).alias("var1"),
        F.count(F.when(g == l2, x)).alias("n2"), F.avg(F.when(g == l2, x)).alias("mean2"),
        F.var_samp(F.when(g == l2, x)).alias("var2"))
    # try_divide: an empty or one-row group gives NULL instead of an ANSI error
    v1 = F.try_divide(F.col("var1"), F.col("n1"))
    v2 = F.try_divide(F.col("var2"), F.col("n2"))
    se = F.sqrt(v1 + v2)
    df_welch = F.try_divide((v1 + v2) * (v1 + v2),
                            F.try_divide(v1 * v1, F.col("n1") - 1) + F.try_divide(v2 * v2, F.col("n2") - 1))
    out = one.select(
        "n1", "mean1", "var1", "n2", "mean2", "var2",
        F.try_divide(F.col("mean1") - F.col("mean2"), se).alias("t"), df_welch.alias("df"))
    if p_value:
        out = out.withColumn("p_value", t_pvalue(F.col("t"), F.col("df")))
    return out


def one_way_anova(df: DataFrame, value: str, group: str, p_value: bool = True) -> DataFrame:
    """One-way ANOVA F test from per-group moments (two aggregates, one pass over rows)."""
    gm = group_moments(df, value, group)
    w = Window.partitionBy(F.lit(0))
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    gm = gm.withColumn("_grand", grand)
    one = gm.agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) * (F.col("mean") - F.col("_grand"))).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ss_within"),
        (F.count(F.lit(1)) - 1).alias("df1"),
        (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    out = one.withColumn("f", F.try_divide(F.try_divide(F.col("ss_between"), F.col("df1")),
                                           F.try_divide(F.col("ss_within"), F.col("df2"))))
    if p_value:
        out = out.withColumn("p_value", f_pvalue(F.col("f"), F.col("df1"), F.col("df2")))
    return out
