"""Exact quantiles by distributed selection.

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here
a sketch (``percentile_approx``, bounded memory) brackets each wanted order
statistic, one pass counts the rows below each bracket exactly, and only the rows
inside go on, as (value, count).  Where many distinct values are left, cut points
divide the bracket again and the counted interval that holds the rank is kept.  The
sketch only saves work: the counts decide, and a bracket that misses its rank is
opened to all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Distinct values of a column (in a group) up to which ``percentile`` is used instead: its map of values is small.
FEW = 100_000
#: Accuracy of the sketch (rank error n / ACCURACY) and cut points of a refining round.
ACCURACY, CUTS = 10_000, 128
#: Distinct values in a bracket that one window may order.
ENOUGH = 50_000


def few_values(df: DataFrame, cols, by=(), few: int = FEW) -> bool:
    """Whether every column has at most about ``few`` distinct values (one pass, bounded memory)."""
    row = df.agg(*[F.approx_count_distinct(F.struct(*by, F.col(c)) if by else F.col(c)) for c in cols]).first()
    return all(n <= few for n in row)


def exact_quantiles(df: DataFrame, cols, probs, by=(), enough: int = ENOUGH, accuracy: int = ACCURACY) -> DataFrame:
    """by, variable, p, value: type-7 quantiles of the non-null, non-NaN values of numeric columns.

    Equal to ``percentile`` (linear interpolation between order statistics) at any number of distinct
    values.  A column without values in a group has no rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)

    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    rows = df.select(*[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], *[value(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    keys = [f"_b{k}" for k in range(len(by))]
    wide = 2.0 / accuracy
    asked = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-wide, wide)})
    sketch = rows.groupBy(*keys).agg(
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(cols))],
        *[F.percentile_approx(f"_x{i}", asked, accuracy).alias(f"_q{i}") for i in range(len(cols))]).checkpoint(eager=True)
    # every target of a group: column, probability, rank of the lower order statistic, bracket
    targets = sketch.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_n{i}").alias("n"),
                 F.floor((F.col(f"_n{i}") - 1) * F.lit(p)).alias("rank"),
                 F.col(f"_q{i}")[asked.index(max(0.0, p - wide))].alias("lo"),
                 F.col(f"_q{i}")[asked.index(min(1.0, p + wide))].alias("hi"))
        for i in range(len(cols)) for j, p in enumerate(probs)])).alias("t")).select(*keys, "t.*").where("n > 0")
    held = targets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        (F.col("i") * len(probs) + F.col("j")).alias("k"), F.struct("lo", "hi")))).alias("_t"))
    joined = _joined(rows, held, keys) if keys else rows.select("*", held.select("_t").scalar().alias("_t"))

    def of(i: int, j: int, end: str) -> Column:
        return F.col("_t")[F.lit(i * len(probs) + j)][end]

    pairs = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    below = joined.groupBy(*keys).agg(*[F.count(F.when(F.col(f"_x{i}") < of(i, j, "lo"), 1)).alias(f"_c{i}_{j}")
                                        for i, j in pairs])
    below = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_c{i}_{j}").alias("below"))
                                                    for i, j in pairs])).alias("c")).select(*keys, "c.*")
    inside = F.array(*[F.when(F.col(f"_x{i}").between(of(i, j, "lo"), of(i, j, "hi")), F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_x{i}").alias("x"))) for i, j in pairs])
    on = [*keys, "i", "j"]
    counted = joined.select(*keys, F.explode(F.array_compact(inside)).alias("v")).groupBy(
        *keys, "v.i", "v.j", "v.x").agg(F.count("*").alias("c")).checkpoint(eager=True)
    state = _joined(targets.select(*on, "n", "rank"), below, on).checkpoint(eager=True)
    sizes = _joined(state, counted.groupBy(*on).agg(F.sum("c").alias("have")), on)
    top = F.least(F.col("rank") + 1, F.col("n") - 1)
    if not sizes.where((F.col("rank") < F.col("below")) | (top >= F.col("below") + F.coalesce("have", F.lit(0)))).isEmpty():
        # the sketch missed a rank: count all values
        every = F.array(*[F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_x{i}").alias("x")))
                          for i, j in pairs])
        counted = rows.select(*keys, F.explode(F.array_compact(every)).alias("v")).groupBy(
            *keys, "v.i", "v.j", "v.x").agg(F.count("*").alias("c")).checkpoint(eager=True)
        state = state.withColumn("below", F.lit(0).cast("long"))
    while not counted.groupBy(*on).agg(F.count("*").alias("m")).where(F.col("m") > enough).isEmpty():
        state, counted = _refined(state, counted, on)
    upto = F.sum("c").over(Window.partitionBy(*on).orderBy("x"))
    seen = _joined(counted, state, on).withColumn("upto", F.col("below") + upto)
    ends = seen.groupBy(*on, "n", "rank").agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("x"))).alias("a"),
                                              F.min(F.when(F.col("upto") > top, F.col("x"))).alias("b"))
    p = F.array(*[F.lit(p) for p in probs])[F.col("j")]
    part = (F.col("n") - 1) * p - F.col("rank")
    return ends.select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], F.array(*[F.lit(c) for c in cols])[F.col("i")].alias("variable"),
        p.alias("p"), F.when(part == 0, F.col("a")).otherwise(F.col("a") + part * (F.col("b") - F.col("a"))).alias("value"))


def _joined(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left join on keys where null equals null."""
    r = right.withColumnsRenamed({k: f"_r{k}" for k in on})
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(r, cond, "left").drop(*[f"_r{k}" for k in on])


def _refined(state: DataFrame, counted: DataFrame, on) -> tuple[DataFrame, DataFrame]:
    """The same targets, their values cut to the interval between cut points that holds the two order statistics."""
    cuts = counted.groupBy(*on).agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 100 * CUTS).alias("cuts"))
    placed = _joined(counted, cuts, on).withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    cells = placed.groupBy(*on, "cell").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*on).orderBy("cell"))
    cells = _joined(cells, state, on).withColumn("upto", F.col("below") + upto)
    top = F.least(F.col("rank") + 1, F.col("n") - 1)
    # from the cell of the lower order statistic to that of the upper one
    bounds = cells.groupBy(*on).agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.struct("cell", (F.col("upto") - F.col("c")).alias("below")))).alias("first"),
        F.min(F.when(F.col("upto") > top, F.col("cell"))).alias("last")).select(
        *on, F.col("first.cell").alias("first"), F.col("first.below").alias("now"), "last").checkpoint(eager=True)
    kept = _joined(placed, bounds, on).where(F.col("cell").between(F.col("first"), F.col("last"))).select(*on, "x", "c")
    state = _joined(state, bounds, on).withColumn("below", F.col("now")).drop("first", "now", "last")
    return state.checkpoint(eager=True), kept.checkpoint(eager=True)
