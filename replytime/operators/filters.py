"""Row filters.  All are plain predicates, so Catalyst pushes what it can
into the Parquet scan (``PushedFilters``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_positive_reply(df: DataFrame, col: str = "reply_time") -> DataFrame:
    """Rows with a strictly positive reply time (``subset = time > 0``)."""
    return df.where(F.col(col) > 0)


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows with no missing value in ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def exclude_trusts(df: DataFrame, spark: SparkSession, codes, key: str = "trustcode") -> DataFrame:
    """Drop the listed trusts (by code, never by level position).

    An anti join; Spark broadcasts the list where its size allows.
    """
    ex = spark.createDataFrame([(c,) for c in codes], T.StructType([T.StructField(key, T.StringType())]))
    return df.join(ex, key, "left_anti")


def trust_rows(df: DataFrame, code: str, cols, key: str = "trustcode") -> DataFrame:
    """Rows of one trust, chosen columns."""
    return df.where(F.col(key) == code).select(*cols)


def list_sample(df: DataFrame, cols, n: int = 50, order=("trustcode", "record")) -> DataFrame:
    """First ``n`` rows in a named order (a top-n sort, not a full sort)."""
    return df.orderBy(*order).select(*order, *[c for c in cols if c not in order]).limit(n)


def non_null_group(df: DataFrame, col: str) -> DataFrame:
    """Rows whose group column is present."""
    return df.where(F.col(col).isNotNull())


def time_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Clip to ``lo <= x <= hi`` before binning or plotting."""
    return df.where(F.col(col).between(lo, hi))
