"""Non-parametric survival tables on Spark.

Every curve is built the same way: rows are first reduced to one row per
(group, distinct time) with a partial (map-side) aggregate, so the row count
that reaches a window is the number of distinct days per group - about a
hundred here, bounded by the time domain, not by the data.  Windows are
always partitioned by the group keys.  Where the times are continuous, so that
the table of distinct times grows with the data, running sums work in blocks
of the time axis instead (``prefix``).  Neither step collects anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .prefix import BLOCK, in_blocks, running

Z975 = 1.959963984540054  # standard normal 97.5% quantile


def survival_pair(df: DataFrame, time: str, event: str, by=(), time_alias="time",
                  event_alias="event") -> DataFrame:
    """(time, event) rows with both present, as the survival object keeps them."""
    return df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).select(
        *by, F.col(time).cast("double").alias(time_alias), F.col(event).cast("int").alias(event_alias))


def stack_curves(df: DataFrame, curves: dict, event: str = "event", by=()) -> DataFrame:
    """One pass over rows for several curves: ``(curve, time, event)`` long form.

    ``curves`` maps a curve name to a time column; all share one event column.
    """
    arr = F.array(*[F.struct(F.lit(name).alias("curve"), F.col(col).cast("double").alias("time"))
                    for name, col in curves.items()])
    return (df.select(*by, F.col(event).cast("int").alias("event"), F.explode(arr).alias("c"))
              .select(*by, F.col("c.curve").alias("curve"), F.col("c.time").alias("time"), "event")
              .where(F.col("time").isNotNull() & F.col("event").isNotNull()))


def event_table(pairs: DataFrame, by=(), time="time", event="event") -> DataFrame:
    """Per (group, time): rows leaving (``n_at``) and events (``n_event``)."""
    return pairs.groupBy(*by, time).agg(F.count(F.lit(1)).alias("n_at"),
                                        F.sum(F.col(event)).cast("long").alias("n_event"))


def _stored_events(pairs: DataFrame, by, time: str, event: str, many: int | None) -> tuple[DataFrame, bool]:
    """The event table, and whether it is dealt in blocks of the time axis.

    With ``many`` it is computed once and dealt if it has more rows than that; without, the caller
    knows that distinct times are few (whole days) and the plan stays one lazy query.
    """
    if many is None:
        return event_table(pairs, by, time, event), False
    ensure_checkpoint_dir(pairs.sparkSession)
    ev = event_table(pairs, by, time, event).checkpoint(eager=True)
    if ev.count() <= many:
        return ev, False
    return in_blocks(ev, time, by), True


def kaplan_meier(pairs: DataFrame, by=(), time="time", event="event", conf: bool = True,
                 conf_type: str = "log", events_only: bool = False, many: int | None = None) -> DataFrame:
    """Kaplan-Meier estimate with Greenwood error and 95% limits.

    Output: ``*by, time, n_risk, n_event, n_censor, surv[, std_err, lower, upper]``;
    one row per distinct time (event or censoring) per group, or only the
    event times with ``events_only`` (the printed summary's rows).
    ``conf_type``: "log" (default), "log-log" or "plain" limits.  For continuous
    times give ``many`` (e.g. ``prefix.MANY``): with more distinct (group, time) the sums run in blocks.
    """
    if conf_type not in ("log", "log-log", "plain"):
        raise ValueError("conf_type must be 'log', 'log-log' or 'plain'")
    ev, blocked = _stored_events(pairs, by, time, event, many)
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    step_ln = F.when(d < n, F.ln(F.lit(1.0) - d / n)).otherwise(F.lit(0.0))
    gw_term = F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))
    zero = F.when(d >= n, 1).otherwise(0)
    if blocked:
        t = running(ev, {"n_risk": "n_at"}, time, by, descending=True)
        t = running(t, {"_zero": zero, "_lnS": step_ln, "_gw": gw_term}, time, by)
        t = t.withColumn("_zero", F.least(F.col("_zero"), F.lit(1))).drop(BLOCK)
    else:
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        w_cum = part.orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        w_prev = part.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
        n_risk = F.sum("n_at").over(part) - F.coalesce(F.sum("n_at").over(w_prev), F.lit(0))
        t = ev.withColumn("n_risk", n_risk.cast("long")).withColumns({
            "_zero": F.max(zero).over(w_cum),
            "_lnS": F.sum(step_ln).over(w_cum),
            "_gw": F.sum(gw_term).over(w_cum),
        })
    surv = F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(F.exp("_lnS"))
    out = t.select(*by, F.col(time).alias("time"), "n_risk", "n_event",
                   (F.col("n_at") - F.col("n_event")).alias("n_censor"), surv.alias("surv"),
                   "_gw", "_zero", "_lnS")
    if events_only:
        out = out.where(F.col("n_event") > 0)
    if not conf:
        return out.drop("_gw", "_zero", "_lnS")
    se_log = F.sqrt(F.col("_gw"))
    live = F.col("_zero") == 0
    z = F.lit(Z975)
    if conf_type == "log":
        lower = F.when(live, F.exp(F.col("_lnS") - z * se_log))
        upper = F.when(live, F.least(F.lit(1.0), F.exp(F.col("_lnS") + z * se_log)))
    elif conf_type == "plain":
        se_s = F.col("surv") * se_log
        lower = F.greatest(F.lit(0.0), F.col("surv") - z * se_s)
        upper = F.least(F.lit(1.0), F.col("surv") + z * se_s)
    else:  # log-log: exp(-exp(log(-log S) +- z se / |log S|)); undefined at S = 1 and S = 0
        ok = live & (F.col("_lnS") < 0)
        ll = F.ln(-F.col("_lnS"))
        w = z * se_log / F.abs(F.col("_lnS"))
        lower = F.when(ok, F.exp(-F.exp(ll + w)))
        upper = F.when(ok, F.exp(-F.exp(ll - w)))
    return out.select(*by, "time", "n_risk", "n_event", "n_censor", "surv",
                      (F.col("surv") * se_log).alias("std_err"), lower.alias("lower"), upper.alias("upper"))


def response_curve(km: DataFrame) -> DataFrame:
    """Cumulative response rate 1 - S(t)."""
    return km.withColumn("response_rate", F.lit(1.0) - F.col("surv"))


def loglogistic_check(km: DataFrame, by=()) -> DataFrame:
    """log((1-S)/S) against log(t); straight lines suggest a log-logistic time."""
    s = F.col("surv")
    ok = (s > 0) & (s < 1) & (F.col("time") > 0)
    return km.select(*by, "time", F.when(ok, F.log(F.col("time"))).alias("log_time"),
                     F.when(ok, F.log((F.lit(1.0) - s) / s)).alias("log_odds_response"))


def align_curves_long(km: DataFrame, names: dict, key: str = "curve", value: str = "response_rate") -> DataFrame:
    """Curves of one long table side by side on one time axis.

    Equivalent to full outer joins on time of the separate curves, but as a
    pivot of the (small) long table: the rows are scanned once, not once per
    curve.  ``names`` maps each curve key to its output column.
    """
    wide = km.groupBy("time").pivot(key, list(names)).agg(F.first(value))
    return wide.select("time", *[F.col(k).alias(v) for k, v in names.items()])


def align_curves(curves: dict[str, DataFrame], value: str = "response_rate") -> DataFrame:
    """Separate one-row-per-time curves side by side on one time axis (full outer joins)."""
    out = None
    for name, c in curves.items():
        c = c.select(F.col("time"), F.col(value).alias(name))
        out = c if out is None else out.join(c, "time", "full")
    return out


def risk_table(pairs: DataFrame, by=(), time="time", event="event", many: int | None = None) -> DataFrame:
    """Per (group, distinct time): ``n_risk`` and ``n_event`` (a running sum over the aggregated table)."""
    ev, blocked = _stored_events(pairs, by, time, event, many)
    if blocked:
        return running(ev, {"n_risk": "n_at"}, time, by, descending=True).select(
            *by, F.col(time).alias("time"), "n_risk", "n_event")
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    at_or_after = part.orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ev.select(*by, F.col(time).alias("time"), F.sum("n_at").over(at_or_after).cast("long").alias("n_risk"),
                     "n_event")


def nelson_aalen_increments(pairs: DataFrame, by=(), time="time", event="event") -> DataFrame:
    """Per distinct time: ``n_risk``, ``n_event`` and hazard increment d/n."""
    rt = risk_table(pairs, by, time, event)
    return rt.withColumn("dH", F.col("n_event").cast("double") / F.col("n_risk").cast("double"))


def hazard_kernel(pairs: DataFrame, bandwidth: float, min_time: float = 0.0, max_time: float = 70.0,
                  n_grid: int = 101, boundary: bool = True, by=()) -> DataFrame:
    """Kernel-smoothed hazard (Epanechnikov) on an even grid.

    h(g) = sum_i K_g((g - t_i)/b) dN_i / Y_i / b over distinct event times.
    Each distinct time contributes only to grid points within one bandwidth:
    the pairs come from ``explode(sequence(lo, hi))`` per event time - a band
    join expressed as a generator, no cross product.  With ``boundary`` the
    kernel near the grid ends is replaced by the boundary-corrected
    Epanechnikov kernel of Mueller and Wang (1994).
    """
    step = (max_time - min_time) / (n_grid - 1)
    inc = nelson_aalen_increments(pairs, by).where(F.col("n_event") > 0)
    t = F.col("time")
    lo = F.greatest(F.lit(0), F.ceil((t - F.lit(bandwidth) - F.lit(min_time)) / F.lit(step)).cast("int"))
    hi = F.least(F.lit(n_grid - 1), F.floor((t + F.lit(bandwidth) - F.lit(min_time)) / F.lit(step)).cast("int"))
    band = inc.where(lo <= hi).select(*by, "time", "dH", F.explode(F.sequence(lo, hi)).alias("j"))
    g = F.lit(min_time) + F.col("j").cast("double") * F.lit(step)
    b = F.lit(float(bandwidth))
    band = band.withColumn("grid_time", g)
    kern = _kernel(F.col("grid_time"), F.col("time"), b, min_time, max_time, boundary)
    out = band.groupBy(*by, "j").agg(F.sum(kern * F.col("dH")).alias("_s"))
    if by:
        grid = inc.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("j"))
    else:
        grid = pairs.sparkSession.range(n_grid).select(F.col("id").cast("int").alias("j"))
    out = grid.join(out, [*by, "j"], "left")
    return out.select(*by, (F.lit(min_time) + F.col("j").cast("double") * F.lit(step)).alias("time"),
                      (F.coalesce(F.col("_s"), F.lit(0.0)) / b).alias("hazard"))


def _kernel(g: Column, t: Column, b: Column, min_time: float, max_time: float, boundary: bool = True) -> Column:
    """Epanechnikov weight of time t at grid point g; with ``boundary`` corrected within b of the ends."""
    x = (g - t) / b
    epan = F.lit(0.75) * (F.lit(1.0) - x * x)
    if not boundary:
        return F.when(F.abs(x) <= 1, epan).otherwise(F.lit(0.0))
    # left boundary: q = (g - min)/b < 1 ; right: q = (max - g)/b < 1
    ql = (g - F.lit(min_time)) / b
    qr = (F.lit(max_time) - g) / b
    kl = _boundary_epanechnikov(x, ql)
    kr = _boundary_epanechnikov(-x, qr)
    kern = F.when(ql < 1, kl).when(qr < 1, kr).otherwise(epan)
    inside = F.when(ql < 1, x <= ql).when(qr < 1, -x <= qr).otherwise(F.lit(True))
    return F.when(inside & (F.abs(x) <= 1), kern).otherwise(F.lit(0.0))


def _boundary_epanechnikov(x: Column, q: Column) -> Column:
    """Boundary kernel for support [-1, q], q in [0, 1) (Mueller & Wang 1994)."""
    one = F.lit(1.0)
    return (F.lit(12.0) / F.pow(one + q, 4)) * (x + one) * (
        x * (one - F.lit(2.0) * q) + (F.lit(3.0) * q * q - F.lit(2.0) * q + one) / F.lit(2.0))


def _grid_near(first: int, last: int, centre: Column, reach: Column) -> Column:
    """Numbers of the grid points at most ``reach`` steps from ``centre`` (in steps); empty if there are none."""
    lo = F.greatest(F.lit(first), F.ceil(centre - reach).cast("int"))
    hi = F.least(F.lit(last), F.floor(centre + reach).cast("int"))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def local_bandwidths(pairs: DataFrame, pilot: float, bandwidths, min_time: float = 0.0, max_time: float = 70.0,
                     n_grid: int = 101, by=()) -> DataFrame:
    """by, j, time, bandwidth, mse: of the given bandwidths the best one at each grid point.

    With a pilot estimate h0 of the hazard and the number at risk Y on the grid, a bandwidth b gives the point g
    the weights p_u = K_b(g, u) / sum K_b of the grid points u near it.  Its estimated squared bias is
    (sum p_u h0(u) - h0(g))^2, its variance sum p_u^2 h0(u) / (Y(u) * step); the best b has the least sum of both (the
    smaller of equal ones).  Grid points at which no one is at risk add no variance, so ``max_time`` should lie within the
    observed times.

    The rows are read for the pilot and the numbers at risk only; what follows works on the grid, whose size the
    arguments alone decide: at most n_grid * n_grid rows a bandwidth and group, in map-side combined sums.
    """
    if not bandwidths or min(bandwidths) <= 0 or pilot <= 0:
        raise ValueError("bandwidths must be positive")
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    keys, step, last = list(by), (max_time - min_time) / (n_grid - 1), n_grid - 1
    if min(bandwidths) <= step:
        raise ValueError(f"bandwidths must be above the grid's step of {step}")
    h0 = hazard_kernel(pairs, pilot, min_time, max_time, n_grid, by=by)
    # rows at risk at grid point j: those whose time is not before it; one aggregate to grid cells, then a sum over the grid
    cell = F.floor((F.col("time") - F.lit(min_time)) / F.lit(step) + F.lit(1e-9)).cast("int")
    leaving = pairs.select(*keys, F.least(cell, F.lit(last)).alias("j")).where("j >= 0").groupBy(*keys, "j").agg(
        F.count(F.lit(1)).alias("_leave"))
    h0 = h0.withColumn("j", F.round((F.col("time") - F.lit(min_time)) / F.lit(step)).cast("int"))
    later = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = later.orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = h0.join(leaving, [*keys, "j"], "left").select(
        *keys, "j", "time", "hazard", F.coalesce(F.sum("_leave").over(later), F.lit(0)).alias("_at_risk")).checkpoint(eager=True)
    width = F.explode(F.array(*[F.lit(float(b)) for b in sorted(set(bandwidths))])).alias("_b")
    wide = grid.select(*keys, F.col("j").alias("_u"), F.col("time").alias("_tu"), F.col("hazard").alias("_hu"), "_at_risk", width)
    spread = wide.select("*", F.explode(_grid_near(0, last, F.col("_u"), F.col("_b") / F.lit(step) + F.lit(1e-9))).alias("j"))
    k = _kernel(F.lit(min_time) + F.col("j").cast("double") * F.lit(step), F.col("_tu"), F.col("_b"), min_time, max_time)
    noise = F.when(F.col("_at_risk") > 0, F.col("_hu") / (F.col("_at_risk") * F.lit(step))).otherwise(F.lit(0.0))
    sums = spread.withColumn("_k", k).groupBy(*keys, "j", "_b").agg(
        F.sum("_k").alias("_k1"), F.sum(F.col("_k") * F.col("_hu")).alias("_kh"), F.sum(F.col("_k") * F.col("_k") * noise).alias("_kv"))
    at = grid.select(*keys, "j", "time", "hazard")
    bias = F.col("_kh") / F.col("_k1") - F.col("hazard")
    errors = sums.where(F.col("_k1") > 0).join(at, [*keys, "j"]).withColumn(
        "mse", bias * bias + F.col("_kv") / (F.col("_k1") * F.col("_k1")))
    # to 12 digits: sums in another order must not choose between equal bandwidths
    best = F.min(F.struct(F.round("mse", 12).alias("mse"), F.col("_b").alias("b"))).alias("_best")
    return errors.groupBy(*keys, "j", "time").agg(best).select(
        *keys, "j", "time", F.col("_best.b").alias("bandwidth"), F.col("_best.mse").alias("mse"))


def hazard_kernel_local(pairs: DataFrame, pilot: float, bandwidths, smooth: float | None = None, min_time: float = 0.0,
                        max_time: float = 70.0, n_grid: int = 101, by=()) -> DataFrame:
    """Kernel-smoothed hazard whose bandwidth follows the time: by, time, bandwidth, hazard.

    The best bandwidths of ``local_bandwidths`` are smoothed over the grid by an Epanechnikov mean of half-width
    ``smooth`` (default 5 * pilot).  Then h(g) = sum of K_b(g)(g, t) dN / Y / b(g) over the event times t within b(g),
    with the boundary kernel of ``hazard_kernel``.  An event time meets the grid points within the largest bandwidth.
    """
    keys, step, last = list(by), (max_time - min_time) / (n_grid - 1), n_grid - 1
    smooth = 5.0 * pilot if smooth is None else float(smooth)
    chosen = local_bandwidths(pairs, pilot, bandwidths, min_time, max_time, n_grid, by)
    near = chosen.select(*keys, F.col("j").alias("_u"), "bandwidth",
                         F.explode(_grid_near(0, last, F.col("j"), F.lit(smooth / step))).alias("j"))
    z = (F.col("j") - F.col("_u")).cast("double") * F.lit(step / smooth)
    # a point's own weight is 1, so the sum of weights is not 0
    w = F.lit(1.0) - z * z
    smoothed = near.groupBy(*keys, "j").agg((F.sum(w * F.col("bandwidth")) / F.sum(w)).alias("bandwidth"))
    smoothed = smoothed.withColumn("_g", F.lit(min_time) + F.col("j").cast("double") * F.lit(step)).checkpoint(eager=True)
    inc = nelson_aalen_increments(pairs, by).where(F.col("n_event") > 0)
    reach = F.lit(float(max(bandwidths)) / step + 1e-9)
    band = inc.select(*keys, "time", "dH", F.explode(_grid_near(
        0, last, (F.col("time") - F.lit(min_time)) / F.lit(step), reach)).alias("j"))
    part = band.join(smoothed, [*keys, "j"])
    k = _kernel(F.col("_g"), F.col("time"), F.col("bandwidth"), min_time, max_time)
    sums = part.groupBy(*keys, "j").agg(F.sum(k * F.col("dH") / F.col("bandwidth")).alias("hazard"))
    return smoothed.join(sums, [*keys, "j"], "left").select(
        *keys, F.col("_g").alias("time"), "bandwidth", F.coalesce("hazard", F.lit(0.0)).alias("hazard"))


def hazard_piecewise(pairs: DataFrame, width: float = 1.0, max_time: float = 70.0, by=()) -> DataFrame:
    """Piecewise-constant hazard: events / person-time per bin, with 95% limits.

    Bins are (a, a + w]: a reply on day t falls in the bin that ends at t.
    Person-time of bin b = w * (rows whose time lies in a later bin) + the
    part of bin b lived by the rows ending in it.  So one aggregate reduces
    the rows to one row per (group, bin) - at most ``max_time / width`` + 1,
    whatever the data or the time resolution - and a reverse running sum over
    the bins gives the person-time.  Bins with no one at risk are omitted.
    """
    nb = int(round(max_time / width))
    t = F.col("time")
    w = F.lit(float(width))
    k = (F.ceil(t / w) - 1).cast("int")
    kk = F.least(k, F.lit(nb))  # nb collects every time beyond the last bin
    per = pairs.where(t > 0).groupBy(*by, kk.alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.when(k < nb, t - k.cast("double") * w).otherwise(F.lit(0.0))).alias("part"),
        F.sum(F.when(k < nb, F.col("event")).otherwise(F.lit(0))).cast("long").alias("ev"))
    keys = list(by)
    bins = F.explode(F.sequence(F.lit(0), F.lit(nb))).alias("bin")
    grid = per.select(*keys).distinct().select(*keys, bins) if keys else \
        pairs.sparkSession.range(1).select(bins)
    full = grid.join(per, [*keys, "bin"], "left").fillna(0.0, subset=["n", "part"]).fillna(0, subset=["ev"])
    later = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = later.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("person_time", w * F.coalesce(F.sum("n").over(later), F.lit(0.0)) + F.col("part"))
    agg = full.where((F.col("bin") < nb) & (F.col("person_time") > 0))
    rate = F.col("ev").cast("double") / F.col("person_time")
    se = F.sqrt(F.col("ev").cast("double")) / F.col("person_time")
    return agg.select(*by, (F.col("bin").cast("double") * w).alias("bin_start"),
                      F.col("ev").alias("events"), "person_time", rate.alias("hazard"),
                      F.greatest(F.lit(0.0), rate - F.lit(Z975) * se).alias("lower"),
                      (rate + F.lit(Z975) * se).alias("upper"))
