"""Keyed joins of the study.  No side is hinted: Spark broadcasts by its own
measure of bytes (adaptively for grouped tables) and shuffles otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import composite_key


def response_rate_by_trust(df: DataFrame, rating: str = "overall_sat", key: str = "trustcode") -> DataFrame:
    """Share of rows with a rating, per trust."""
    return df.groupBy(key).agg(
        (F.count(rating).cast("double") / F.count(F.lit(1)).cast("double")).alias("response_rate"))


def attach_response_rate(df: DataFrame, rates: DataFrame, key: str = "trustcode") -> DataFrame:
    """Left outer join of the per-trust rate (one row per trust) to every row."""
    return df.join(rates, key, "left")


def with_pid(df: DataFrame, trust: str = "trustcode", record: str = "record") -> DataFrame:
    """Add the composite id ``trust.record``."""
    return df.withColumn("pid", composite_key(trust, record))


def wave_subset_join(df: DataFrame, subset: DataFrame, keys=("trustcode", "record")) -> DataFrame:
    """Inner join to a scored subset on trust and record; adds the composite id ``trust.record``."""
    return with_pid(df.join(subset, list(keys), "inner"))


def bind_imputed(left: DataFrame, right: DataFrame, keys=("trustcode", "record")) -> DataFrame:
    """Columns of two files side by side, matched by key instead of position.

    The files must hold the same rows: a row of either without its partner
    fails the job (found in the same pass, by a full outer join).
    """
    a = left.withColumn("in_left__", F.lit(True))
    b = right.withColumn("in_right__", F.lit(True))
    both = F.col("in_left__").isNotNull() & F.col("in_right__").isNotNull()
    said = F.concat_ws(" ", F.lit("bind_imputed: no partner for"), *[F.col(k).cast("string") for k in keys])
    out = a.join(b, list(keys), "full").where(F.when(both, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    return out.drop("in_left__", "in_right__")
