"""Descriptive aggregates.  Each is one partial-aggregated pass over rows;
the few window functions run on the already aggregated table (a handful of
rows per group), never on row data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import FEW, exact_quantiles, few_values


def _explode_columns(df: DataFrame, cols, by=(), cast="string") -> DataFrame:
    """Long form ``(*by, variable, value)`` in one pass (no union of scans)."""
    arr = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(*by, F.explode(arr).alias("kv")).select(
        *by, F.col("kv.variable").alias("variable"), F.col("kv.value").alias("value"))


def column_summary(df: DataFrame, cols, exact: bool = True, accuracy: int = 10000, few: int = FEW) -> DataFrame:
    """min, quartiles (type 7), mean, max and NA count of numeric columns.

    One aggregate computes every statistic of every column; the one-row
    result is unpivoted to one row per column.  ``exact`` uses ``percentile``
    where the columns have few distinct values (``few``, by a first pass in bounded
    memory), else distributed selection, which gives the same values;
    ``exact=False`` is ``percentile_approx``.
    """
    selected = exact and not few_values(df, cols, few=few)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if selected:
            q = F.lit(None).cast("array<double>")
        else:
            q = (F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if exact
                 else F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy))
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count(F.lit(1)).alias("n"),
            (F.count(F.lit(1)) - F.count(x)).alias("n_na"), F.min(x).alias("min"),
            q.getItem(0).alias("q1"), q.getItem(1).alias("median"), F.avg(x).alias("mean"),
            q.getItem(2).alias("q3"), F.max(x).alias("max")).alias(f"s{len(aggs)}"))
    one = df.agg(*aggs)
    out = one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(aggs))])).alias("s")).select("s.*")
    if not selected:
        return out
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("variable").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return out.drop("q1", "median", "q3").join(q, "variable", "left").select(out.columns)


def level_counts(df: DataFrame, cols) -> DataFrame:
    """Counts of every level (NULL included) of categorical columns, long form."""
    return _explode_columns(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_by_column(df: DataFrame, cols=None, digits: int = 2) -> DataFrame:
    """NAs, N and rounded share missing for each column (one pass)."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col("_n") - F.col(f"_c{i}")).alias("nas"))
                    for i, c in enumerate(cols)])
    out = one.select(F.col("_n").alias("n"), F.explode(arr).alias("s")).select("s.variable", "s.nas", "n")
    return out.withColumn("prop_na", F.round(F.try_divide(F.col("nas"), F.col("n")), digits))


def missing_by_trust(df: DataFrame, cols, key: str = "trustcode", digits: int = 2) -> DataFrame:
    """Share missing of each column within each trust (the intended per-group value)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                            *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col("_n") - F.col(f"_c{i}")).alias("nas"))
                    for i, c in enumerate(cols)])
    out = g.select(key, F.col("_n").alias("n"), F.explode(arr).alias("s")).select(key, "s.variable", "s.nas", "n")
    return out.withColumn("prop_na", F.round(F.try_divide(F.col("nas"), F.col("n")), digits))


def overall_response_rate(df: DataFrame) -> DataFrame:
    """Returned / (returned + not returned); and the before-first-reminder share.

    ``early_rate`` follows the study's arithmetic: replies to the first
    mailing over (those replies + all non-returns).
    """
    no, s = F.col("new_outcome"), F.col("reply_strata")
    one = df.agg(F.count(F.when(no == "Returned", 1)).alias("n_returned"),
                 F.count(F.when(no == "Not returned", 1)).alias("n_not_returned"),
                 F.count(F.when(s == "Mail1", 1)).alias("n_mail1"),
                 F.count(F.lit(1)).alias("n_rows"))
    ret, nr, m1 = (F.col(c).cast("double") for c in ("n_returned", "n_not_returned", "n_mail1"))
    return one.select("n_rows", "n_returned", "n_not_returned", "n_mail1",
                      F.try_divide(ret, ret + nr).alias("response_rate"),
                      F.try_divide(m1, m1 + nr).alias("early_rate"))


def max_received_by_trust(df: DataFrame, key: str = "trustcode", col: str = "date_rec") -> DataFrame:
    """Last received date per trust."""
    return df.groupBy(key).agg(F.max(col).alias("max_date_rec"))


def freq_table(df: DataFrame, cols, include_na: bool = True) -> DataFrame:
    """One-way counts of several variables in one pass, long form."""
    long = _explode_columns(df, cols)
    if not include_na:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def freq_percent(df: DataFrame, col: str, include_na: bool = False) -> DataFrame:
    """Counts with percent of total (window over the aggregated levels only)."""
    src = df if include_na else df.where(F.col(col).isNotNull())
    g = src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("pct", F.col("n").cast("double") * F.lit(100.0) / tot)


def cross_table(df: DataFrame, a: str, b: str, include_na: bool = False) -> DataFrame:
    """Two-way counts with row, column and total proportions (long form)."""
    src = df if include_na else df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = src.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return g.select(
        a, b, "n",
        (n / F.sum("n").over(Window.partitionBy(a))).alias("prop_row"),
        (n / F.sum("n").over(Window.partitionBy(b))).alias("prop_col"),
        (n / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("prop_total"))


def prop_table_margin(df: DataFrame, a: str, b: str, margin: int) -> DataFrame:
    """Proportions within rows (margin 1) or columns (margin 2); NA excluded."""
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = src.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    part = a if margin == 1 else b
    return g.withColumn("prop", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(part)))


def crosstab_wide(df: DataFrame, a: str, b: str, b_levels) -> DataFrame:
    """Matrix form: one row per level of ``a``, one count column per level of ``b``.

    The pivot values are given, so no extra distinct job runs.
    """
    src = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    wide = src.groupBy(a).pivot(b, list(b_levels)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(b_levels))


def medians(df: DataFrame, cols, few: int = FEW) -> DataFrame:
    """Exact medians (interpolated) of several columns: one pass where they have few distinct values, else selection."""
    if not few_values(df, cols, few=few):
        q = exact_quantiles(df, cols, [0.5])
        return q.agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(f"median_{c}") for c in cols])
    return df.agg(*[F.median(F.col(c).cast("double")).alias(f"median_{c}") for c in cols])


def mean_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean (and count) of ``value`` per non-null group."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(F.col(value).cast("double")).alias(f"mean_{value}"),
        F.count(F.col(value)).alias("n"))


def returned_without_date(df: DataFrame) -> DataFrame:
    """Data-quality counts: usable returns without a rating or without a reply time."""
    ret = F.col("outcome") == "Returned useable questionnaire"
    return df.agg(
        F.count(F.when(ret, 1)).alias("n_returned"),
        F.count(F.when(ret & F.col("overall_sat").isNull(), 1)).alias("returned_no_rating"),
        F.count(F.when(ret & F.col("reply_strata").isNull(), 1)).alias("returned_no_strata"),
        F.count(F.when(ret & F.col("overall_sat").isNotNull() & F.col("reply_strata").isNull(), 1))
         .alias("rated_no_reply_time"))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """Count, mean and sample variance of ``value`` per group."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def level_codes(df: DataFrame, dictionary: DataFrame, variables) -> DataFrame:
    """Dictionary levels with their counts and codes among the levels in use.

    ``dictionary`` is ``(variable, level, ord)``.  Counts come from one pass over the rows (long form of the
    listed columns); code = rank of ``ord`` among levels with a count > 0,
    i.e. unused levels are dropped before numbering.
    """
    counts = _explode_columns(df, variables).where(F.col("value").isNotNull()).groupBy(
        "variable", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    dic = dictionary.where(F.col("variable").isin(*variables)).select("variable", "level", "ord")
    j = dic.join(counts, ["variable", "level"], "left").fillna(0, subset=["n"])
    used = F.when(F.col("n") > 0, F.col("ord"))
    w = Window.partitionBy("variable").orderBy(used.asc_nulls_last())
    code = F.when(F.col("n") > 0, F.dense_rank().over(w))
    return j.select("variable", "level", "ord", "n", code.cast("int").alias("code"))
