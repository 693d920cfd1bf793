"""Tables behind the study's figures (the drawing itself is not built).

Rows are reduced first (bin counts, or distinct values with counts), so the
per-figure work after the first aggregate is independent of the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..models.suffstats import collapse
from .quantiles import FEW, exact_quantiles

_SQRT_2PI = math.sqrt(2.0 * math.pi)


def histogram_density(df: DataFrame, value: str, width: float, by=(), origin: float = 0.0) -> DataFrame:
    """Bin counts and density n / (N * width) per group; bins [a, a + width)."""
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull())
    b = F.floor((x - F.lit(origin)) / F.lit(width)).cast("long")
    g = src.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return g.select(*by, (F.lit(origin) + F.col("bin").cast("double") * F.lit(width)).alias("bin_start"),
                    "n", (F.col("n").cast("double") / (tot.cast("double") * F.lit(width))).alias("density"))


def bw_nrd0(n, sd, iqr):
    """Silverman's rule of thumb as a Column expression (0.9 min(sd, IQR/1.34) n^-1/5)."""
    lo = F.least(sd, iqr / F.lit(1.34))
    lo = F.when(lo > 0, lo).when(sd > 0, sd).otherwise(F.lit(1.0))
    return F.lit(0.9) * lo * F.pow(n.cast("double"), F.lit(-0.2))


def to_nodes(values: DataFrame, by, fine: int) -> DataFrame:
    """The counts c of values x moved to nodes g0 + k * bw / fine, each split linearly between the two nearest."""
    pos = (F.col("x") - F.col("g0")) / F.col("bw") * F.lit(float(fine))
    low, part = F.floor(pos), pos - F.floor(pos)
    two = F.array(F.struct(low.alias("node"), (F.col("c") * (F.lit(1.0) - part)).alias("m")),
                  F.struct((low + 1).alias("node"), (F.col("c") * part).alias("m")))
    keys = [*by, "n", "bw", "g0", "step"]
    split = values.select(*keys, F.explode(two).alias("_t"))
    nodes = split.groupBy(*keys, F.col("_t.node").alias("_node")).agg(F.sum("_t.m").alias("c"))
    return nodes.withColumn("x", F.col("g0") + F.col("_node") * F.col("bw") / F.lit(float(fine)))


def kde_density(df: DataFrame, value: str, by=(), n_grid: int = 512, cut: float = 3.0,
                support_sd: float = 40.0, exact: bool = True, accuracy: int = 10000, few: int = FEW,
                fine: int = 64) -> DataFrame:
    """Gaussian kernel density per group on ``n_grid`` points from min - cut*bw to max + cut*bw.

    Rows are reduced to (group, distinct value, count).  Each distinct value
    contributes to the grid points within ``support_sd`` bandwidths
    (``explode(sequence)``, a band join, not a cross product).  Beyond 38.6
    bandwidths exp(-z^2/2) underflows to exactly 0.0 in double precision, so
    the default band of 40 gives the same sum as all pairs.  The grid itself is
    generated per group (fixed size) and left-joined so every grid point is
    present.

    With more than ``few`` distinct (group, value) the mass of a value is first split
    linearly between the two nearest nodes, ``fine`` of them a bandwidth, and the
    nodes take the values' place: at most (xmax - xmin) / bw * fine + 2 a group.
    A node is met by the grid points within ``support_sd`` bandwidths, and these
    are at most ``n_grid``, so the sums grow neither with rows nor with distinct values.
    The density is then at most 1 / (8 * sqrt(2 pi) * fine^2 * bw) off (the error of
    a linear interpolation of the kernel, whose second derivative is largest at 0),
    with 64 nodes 1.2e-5 / bw.
    """
    if fine < 1:
        raise ValueError("fine must be 1 or more")
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull()).select(*by, x.alias("x"))
    # the (value, count) table feeds four branches below: checkpointed once so the
    # rows are read once (branches are pruned differently, so no exchange reuse)
    vals = collapse(src, [*by, "x"], {"c": F.count(F.lit(1))})
    # bandwidth inputs from the (value, count) table - no second pass over rows:
    # weighted exact quartiles, then a two-pass variance on the small table
    p1 = vals.groupBy(*by).agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("mean"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    many = vals.count() > few
    if exact and many:
        qs = _selected(src, "x", by, [0.25, 0.75])
    elif exact:
        qs = vals.groupBy(*by).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)), F.col("c")).alias("q"))
    else:
        qs = src.groupBy(*by).agg(F.percentile_approx("x", [0.25, 0.75], accuracy).alias("q"))
    p1 = p1.join(qs, list(by)) if by else p1.select("*", qs.select("q").scalar().alias("q"))
    keys = list(by)
    vm = vals.join(p1.select(*keys, "mean"), keys) if keys else vals.select(
        "*", p1.select(F.col("mean")).scalar().alias("mean"))
    ss = vm.groupBy(*by).agg(F.sum(F.col("c") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))
                             .alias("ss"))
    params = (p1.join(ss, keys) if keys else p1.select("*", ss.select("ss").scalar().alias("ss")))
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / (F.col("n") - F.lit(1))))
    params = params.select(*by, "n", "xmin", "xmax", sd.alias("sd"),
                           (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    params = params.withColumn("bw", bw_nrd0(F.col("n"), F.coalesce(F.col("sd"), F.lit(0.0)), F.col("iqr")))
    params = params.withColumns({
        "g0": F.col("xmin") - F.lit(cut) * F.col("bw"),
        "step": (F.col("xmax") - F.col("xmin") + F.lit(2.0 * cut) * F.col("bw")) / F.lit(float(n_grid - 1)),
    })
    if keys:
        j = vals.join(params.select(*keys, "n", "bw", "g0", "step"), keys)
    else:
        # one group: the parameters are a single row, attached as a scalar subquery
        p = params.select(F.struct("n", "bw", "g0", "step").alias("p")).scalar()
        j = vals.select("*", p.getField("n").alias("n"), p.getField("bw").alias("bw"),
                        p.getField("g0").alias("g0"), p.getField("step").alias("step"))
    if many:
        j = to_nodes(j, by, fine)
    reach = F.lit(support_sd) * F.col("bw")
    lo = F.greatest(F.lit(0), F.ceil((F.col("x") - reach - F.col("g0")) / F.col("step")).cast("int"))
    hi = F.least(F.lit(n_grid - 1), F.floor((F.col("x") + reach - F.col("g0")) / F.col("step")).cast("int"))
    band = j.where(lo <= hi).select(*by, "x", "c", "n", "bw", "g0", "step",
                                    F.explode(F.sequence(lo, hi)).alias("j"))
    gx = F.col("g0") + F.col("j").cast("double") * F.col("step")
    z = (gx - F.col("x")) / F.col("bw")
    contrib = F.col("c").cast("double") * F.exp(F.lit(-0.5) * z * z)
    sums = band.groupBy(*by, "j").agg(F.sum(contrib).alias("_s"))
    grid = params.select(*by, "n", "bw", "g0", "step",
                         F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("j"))
    out = grid.join(sums, [*by, "j"], "left")
    dens = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("bw") * F.lit(_SQRT_2PI))
    return out.select(*by, "j", (F.col("g0") + F.col("j").cast("double") * F.col("step")).alias("x"),
                      dens.alias("density"), "bw")


def _selected(rows: DataFrame, value: str, by, probs) -> DataFrame:
    """by, q: the exact quantiles of a column as an array, by distributed selection."""
    q = exact_quantiles(rows, [value], probs, by)
    return q.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("p") == p, F.col("value"))) for p in probs]).alias("q"))


def boxplot_stats(df: DataFrame, value: str, group: str, coef: float = 1.5, exact: bool = True,
                  accuracy: int = 10000, few: int = FEW) -> DataFrame:
    """Median, hinges (type-7 quartiles), whiskers at 1.5 IQR and outlier count per group.

    Rows are reduced once to (group, distinct value, count); the quartiles
    (exact, weighted by the counts), whisker ends and outlier count all come
    from that table and the fences joined to it (one row per group).  With more
    than ``few`` distinct values the quartiles come from distributed selection;
    with ``exact=False`` from ``percentile_approx`` over the rows.
    """
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull() & F.col(group).isNotNull()).select(group, x.alias("y"))
    # one pass over rows: everything below works on (group, value, count),
    # checkpointed because three branches read it
    vals = collapse(src, [group, "y"], {"c": F.count(F.lit(1))})
    if exact and vals.count() > few:
        q = vals.groupBy(group).agg(F.sum("c").alias("n")).join(
            _selected(src, "y", [group], [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q"), group)
    elif exact:
        q = vals.groupBy(group).agg(
            F.sum("c").alias("n"),
            F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c")).alias("_q"))
    else:
        # continuous values: bounded-memory quantile sketch over the rows
        q = src.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                   F.percentile_approx("y", [0.25, 0.5, 0.75], accuracy).alias("_q"))
    q = q.select(group, "n", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("middle"),
                 F.col("_q")[2].alias("upper"))
    iqr = F.col("upper") - F.col("lower")
    q = q.withColumns({"_lo": F.col("lower") - F.lit(coef) * iqr, "_hi": F.col("upper") + F.lit(coef) * iqr})
    y = F.col("y")
    inside = (y >= F.col("_lo")) & (y <= F.col("_hi"))
    w = vals.join(q.select(group, "_lo", "_hi"), group).groupBy(group).agg(
        F.min(F.when(inside, y)).alias("ymin"), F.max(F.when(inside, y)).alias("ymax"),
        F.sum(F.when(~inside, F.col("c")).otherwise(F.lit(0))).cast("long").alias("n_out"))
    return q.join(w, group).select(group, "n", "ymin", "lower", "middle", "upper", "ymax", "n_out")
