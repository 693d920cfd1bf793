"""Running sums over an order that one task can't hold.

A table is dealt once by ranges of its order (``in_blocks``); a running sum is
then a sum inside each block plus the total of the blocks before it.  Blocks
are taken together in runs of ``RUN``, so the offsets need no window over all
blocks either: work and memory of a task are those of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Blocks whose offsets are summed in one window.
RUN = 256
#: Distinct values of an order beyond which sums run in blocks instead of in one window a group.
MANY = 200_000
BLOCK = "_block"


def in_blocks(df: DataFrame, order: str, by=(), blocks: int | None = None) -> DataFrame:
    """The table dealt by ranges of (by, order) with the number of its range, checkpointed.

    Rows of equal (by, order) share a block.  There are as many blocks as the
    session has shuffle partitions, unless given.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by, order).withColumn(BLOCK, F.spark_partition_id()).checkpoint(eager=True)


def _offsets(totals: DataFrame, names: list[str], by, descending: bool) -> DataFrame:
    """by, block and for each name the sum over the blocks before (after, if descending)."""
    run = F.floor(F.col(BLOCK) / RUN)
    t = totals.withColumn("_run", run)
    order = F.col(BLOCK).desc() if descending else F.col(BLOCK).asc()
    inside = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = t.select(*by, BLOCK, "_run", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in names])
    runs = t.groupBy(*by, "_run").agg(*[F.sum(c).alias(c) for c in names])
    # a run counts for all later ones: their number is the number of blocks / RUN
    ends = t.groupBy(*by).agg(F.min("_run").alias("_lo"), F.max("_run").alias("_hi")) if by else None
    if by:
        runs = runs.join(ends, list(by))
    else:
        runs = runs.select("*", t.agg(F.struct(F.min("_run").alias("_lo"), F.max("_run").alias("_hi"))).scalar().alias("_e"))
        runs = runs.withColumns({"_lo": F.col("_e._lo"), "_hi": F.col("_e._hi")})
    first, last = (F.col("_lo"), F.col("_run") - 1) if descending else (F.col("_run") + 1, F.col("_hi"))
    later = runs.where(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("_run"), *names)
    far = later.groupBy(*by, "_run").agg(*[F.sum(c).alias(f"_far_{c}") for c in names])
    return near.join(far, [*by, "_run"], "left").select(
        *by, BLOCK, *[(F.col(c) + F.coalesce(F.col(f"_far_{c}"), F.lit(0))).alias(c) for c in names])


def running(df: DataFrame, sums: dict[str, Column | str], order: str, by=(), descending: bool = False) -> DataFrame:
    """Adds for each name the sum of its expression over the rows of the group up to this one in the order.

    ``df`` has the block column of ``in_blocks``; with ``descending`` the sums run from the end.
    """
    names = list(sums)
    terms = {f"_v{i}": F.expr(e) if isinstance(e, str) else e for i, e in enumerate(sums.values())}
    made = df.withColumns(terms)
    offsets = _offsets(made.groupBy(*by, BLOCK).agg(*[F.sum(v).alias(f"_o{i}") for i, v in enumerate(terms)]),
                       [f"_o{i}" for i in range(len(names))], by, descending)
    way = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, BLOCK).orderBy(way).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = made.select(*df.columns, *[F.sum(v).over(inside).alias(v) for v in terms])
    # of the keys of both sides the names are equal; null groups are equal too
    o = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, BLOCK])],
                       *[f"_o{i}" for i in range(len(names))])
    same = F.lit(True)
    for i, c in enumerate([*by, BLOCK]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return own.join(o, same, "left").select(
        *df.columns, *[(F.col(f"_v{i}") + F.coalesce(F.col(f"_o{i}"), F.lit(0))).alias(n) for i, n in enumerate(names)])
