"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replytime.session import ensure_checkpoint_dir

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Rows of one Arrow batch at most: a batch of long texts must fit a Python worker.  Spark bounds its bytes (64 MB); a
#: bound of 8 MB was tried and raised the JVM's memory by 700 MB in the shingle join.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch (the session's own smaller bound stays).

    The returned tables are computed later, so the setting stays with the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns a Python worker's unused memory to the machine.

    Spark keeps idle workers for later tasks; what one of them once needed would
    otherwise stay with it while others work.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that gives unused memory back at its end."""

    def with_end(batches: Iterator) -> Iterator:
        if pa.default_memory_pool().backend_name != "system":
            pa.set_memory_pool(pa.system_memory_pool())  # its free memory can be trimmed
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_end


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the jobs run inside; the session has its own again afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def cut(df: DataFrame) -> DataFrame:
    """The table as written to the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def sample_by_hash(rows: DataFrame, by: Column, most: int, group: Column | None = None) -> DataFrame:
    """About `most` rows (of each group), chosen by the hash `by` alone; all rows where there are fewer.

    The rows are counted, and those whose hash lies in the lowest share
    most / count of its range are taken: nothing is ranked or moved.  The
    groups must be few (languages).  The number taken varies by its root.
    """
    keyed = (F.lit("") if group is None else group).cast("string")
    limit = F.lit(None).cast("double")
    for g, n in rows.groupBy(keyed.alias("g")).agg(F.count("*").alias("n")).collect():
        share = min(1.0, most / max(1, n))
        limit = F.when(keyed.eqNullSafe(F.lit(g)), F.lit(share)).otherwise(limit)
    return rows.where((by.cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64) <= limit)


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared checkpoint folder and read again.

    Unlike a checkpoint, the read table has a size that Spark knows, so a small
    one is broadcast by Spark's own size check and a large one is not.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
