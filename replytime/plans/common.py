"""Shared inputs of the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import censor_facts, derive_wave
from ..sources import scan
from ..sources.fixture import inpatient


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw questionnaire rows of the stand-in 2009 wave."""
    return inpatient(spark, sf_dir)


_FACTS: dict[tuple[str, str], tuple] = {}


def derived(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Analysis table of the stand-in 2009 wave.

    The wave's two global facts are read once a session, so a query scans the
    wave once.
    """
    wave = inpatient(spark, sf_dir)
    if kw.get("censor_by") or kw.get("censor_by_trust"):
        return derive_wave(wave, **kw)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = censor_facts(wave)
    return derive_wave(wave, facts=_FACTS[key], **kw)


WAVES = (2006, 2007, 2008, 2009)


def four_waves(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """Stand-in files of four years: each has rows, dates and column names of its own.

    A row's year follows from its record number; its dates are moved back by
    whole years, so every wave has its own last received date.
    """
    base = raw(spark, sf_dir)
    out = {}
    for k, w in enumerate(WAVES):
        back = F.lit(float((w - 2009) * 365 * 86400))
        own = base.where(F.col("record") % 4 == k).withColumns(
            {c: F.col(c) + back for c in ("mailing1", "mailing2", "mailing3", "daterec")})
        out[w] = scan.as_wave(own, w)
    return out


def all_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four waves renamed and unioned."""
    return scan.wave_union(four_waves(spark, sf_dir))


#: A finely divided reply time (exact in binary): as many distinct values as (day, length of stay).
FINE_SQL = "(CAST(reply_time AS DOUBLE) + CAST(los AS DOUBLE) / 1024.0E0)"


def fine_times(d: DataFrame) -> DataFrame:
    """The derived table with fine_time, the stand-in for a time that is measured continuously."""
    return d.withColumn("fine_time", F.col("reply_time").cast("double") + F.col("los").cast("double") / F.lit(1024.0))
