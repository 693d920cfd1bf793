"""Named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL.

Each query module registers its entries with ``@query(name, sql=...)``.
A query without SQL is checked in the test-suite by closed forms or
estimating equations instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator registering a query (and its oracle SQL, if any)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every floating column (sum order is not fixed across engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so all queries are registered."""
    from . import q_sources, q_projections, q_aggregates, q_survival, q_models, q_streaming  # noqa: F401
