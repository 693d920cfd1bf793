"""Model fits: closed forms, estimating equations and limiting cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.functions.distributions import chi2_sf, f_sf, t_sf2
from replytime.models import cox as CX
from replytime.models.aft import _newton_pieces, aft_frame, fit_loglogistic
from replytime.models.design import Factor, Numeric, build_design, design_frame
from replytime.models.glm import fit_logit
from replytime.models.glmm import fit_glmm_logit
from replytime.models.lm import fit_lm, model_frame
from replytime.models.lmm import fit_lmm
from replytime.models.ordinal import fit_ordinal
from replytime.models.suffstats import agg_vector, collapse
from replytime.plans.q_models import COVARS, FULL, TRI, TRI_ORD


def test_distribution_values():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(t_sf2(2.0, 10) - 0.07338803477074) < 1e-10
    assert abs(f_sf(98.2, 4, 77346) - 0.0) < 1e-12
    assert abs(chi2_sf(4.0, 2) - math.exp(-2.0)) < 1e-14


def test_ols_normal_equations(spark, derived001):
    fit = fit_lm(derived001, "reply_time", FULL)
    mf = model_frame(derived001, fit.design, "reply_time")
    eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(fit.beta)), F.lit(0.0))
    xr = agg_vector(mf, [F.sum(F.col(f"x{i}") * (F.col("y") - eta)) for i in range(fit.design.p)])
    assert np.max(np.abs(xr)) < 1e-6
    assert 0 < fit.r2 < 1


def test_ols_single_factor_is_group_means(spark, derived001):
    fit = fit_lm(derived001, "reply_time", [TRI])
    means = {r.overall_tri: r.m for r in derived001.where(F.col("overall_tri").isNotNull()).groupBy(
        "overall_tri").agg(F.avg("reply_time").alias("m")).collect()}
    assert abs(fit.beta[0] - means["Excellent"]) < 1e-9
    assert abs(fit.beta[0] + fit.beta[1] - means["Other"]) < 1e-9


def test_logit_score_is_zero_and_matches_log_odds(spark, derived001):
    fit = fit_logit(derived001, "rep_mail", "Repeated", [TRI])
    g = derived001.where(F.col("overall_tri").isNotNull() & F.col("rep_mail").isNotNull()).groupBy(
        "overall_tri").agg(F.avg((F.col("rep_mail") == "Repeated").cast("double")).alias("p")).collect()
    p = {r.overall_tri: r.p for r in g}
    lo = {k: math.log(v / (1 - v)) for k, v in p.items()}
    assert abs(fit.beta[0] - lo["Excellent"]) < 1e-9
    assert abs(fit.beta[2] - (lo["Very good"] - lo["Excellent"])) < 1e-9


def test_aft_gradient_zero_and_robust(spark, derived001):
    fit = fit_loglogistic(derived001, "reply_time", "event", [TRI], cluster="trustcode")
    frame = aft_frame(derived001, fit.design, "reply_time", "event")
    coll = collapse(frame, [f"x{i}" for i in range(fit.design.p)] + ["logt", "event"],
                    {"w": F.count(F.lit(1)).cast("double")}, checkpoint=False)
    g, h, _ = _newton_pieces(coll, fit.beta, fit.log_scale, fit.design.p, F.col("w"))
    assert np.max(np.abs(g)) < 1e-5
    assert np.all(np.linalg.eigvalsh(h) < 0)
    assert fit.robust_cov.shape == (4, 4) and np.all(np.diag(fit.robust_cov) > 0)


def test_cox_score_zero(spark, derived001):
    fit = CX.fit_cox(derived001, "reply_time", "event", [TRI])
    p = fit.design.p
    frame = CX.cox_frame(derived001, fit.design, "reply_time", "event")
    coll = collapse(frame, [f"x{i}" for i in range(p)] + ["time"],
                    {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")},
                    checkpoint=False)
    cc = coll.select(*[(F.col(f"x{j}") - F.lit(float(fit.means[j]))).alias(f"x{j}") for j in range(p)],
                     "time", "n_at", "n_ev")
    ll, u, info = CX._step_pieces(cc, fit.beta, p)
    assert np.max(np.abs(u)) < 1e-6
    assert ll >= fit.loglik0


def test_efron_sums_equal_direct_sums():
    """One formula for every number of ties and every share of the risk set."""
    for d in (1, 2, 63, 64, 65, 200, 5000, 10 ** 6):
        for ratio in (1.0, 1.0 + 1e-9, 1.5, 2.3, 10.0, 1e3, 1e6, 1e9):
            e0 = 0.7 * d
            s0 = ratio * e0
            f = np.arange(d, dtype=np.longdouble) / d
            den = s0 - f * e0
            want = [np.log(den).sum(), (1 / den).sum(), (f / den).sum(), (1 / den ** 2).sum(), (f / den ** 2).sum(),
                    (f * f / den ** 2).sum()]
            got = CX.efron_sums(s0, e0, d)
            for a, b in zip(want, got):
                assert abs(float(a) - float(b[0])) <= 1e-10 * max(abs(float(a)), 1e-12), (d, ratio)


def test_ordinal_terms_stay_finite_in_the_tails(spark):
    """Rows of every category far from the thresholds: no division by zero, no row left out of the sum."""
    from replytime.models import ordinal as O
    for eta in (-1e3, -50.0, 0.3, 50.0, 1e3):
        rows = spark.createDataFrame([(eta, k, 1.0) for k in (1, 2, 3)], "x0 double, k int, w double")
        g, h, ll = O._pieces(rows, np.array([1.0]), np.array([-1.0, 1.0]), 1, 3)
        assert np.all(np.isfinite(g)) and np.all(np.isfinite(h)) and np.isfinite(ll)
        if abs(eta) <= 50:
            sp = lambda u: np.logaddexp(0, u)
            a, b = -1 - eta, 1 - eta
            want = -sp(-a) + (-sp(-b) - sp(a) + np.log(-np.expm1(a - b))) - sp(b)
            assert abs(ll - want) < 1e-9 * (1 + abs(want))
    broken = spark.createDataFrame([(float("nan"), 1, 1.0), (0.0, 2, 1.0)], "x0 double, k int, w double")
    assert not np.isfinite(O._pieces(broken, np.array([1.0]), np.array([-1.0, 1.0]), 1, 3)[2])


def test_separated_data_is_refused(spark):
    from replytime.models.suffstats import NotConverged
    rows = spark.createDataFrame([(float(k), "yes" if k > 5 else "no") for k in range(12)], "x double, y string")
    with pytest.raises(NotConverged):
        fit_logit(rows, "y", "yes", [Numeric("x")])


def test_ordinal_score_zero_and_intercepts(spark, derived001):
    fit = fit_ordinal(derived001, "overall_tri", TRI_ORD, [Numeric("reply_time")] + COVARS)
    assert np.all(np.diff(fit.zeta) > 0)
    null = fit_ordinal(derived001, "overall_tri", TRI_ORD, [])
    cnt = {r.overall_tri: r["count"] for r in derived001.where(F.col("overall_tri").isNotNull())
           .groupBy("overall_tri").count().collect()}
    n = sum(cnt.values())
    c1 = cnt["Other"] / n
    assert abs(null.zeta[0] - math.log(c1 / (1 - c1))) < 1e-8


def test_lmm_balanced_equals_anova(spark):
    # 4 trusts x 5 rows; ANOVA estimator of the intercept variance
    rng = np.random.default_rng(3)
    rows = []
    for j in range(4):
        a = rng.normal(0, 2)
        for i in range(5):
            rows.append((f"T{j}", float(10 + a + rng.normal(0, 1))))
    df = spark.createDataFrame(rows, "trustcode string, y double")
    fit = fit_lmm(df, "y", [], "trustcode")
    ys = np.array([r[1] for r in rows]).reshape(4, 5)
    msw = ((ys - ys.mean(axis=1, keepdims=True)) ** 2).sum() / (20 - 4)
    msb = 5 * ((ys.mean(axis=1) - ys.mean()) ** 2).sum() / 3
    assert abs(fit.sigma ** 2 - msw) < 1e-4 * msw
    assert abs(fit.sigma_a ** 2 - (msb - msw) / 5) < 1e-3 * max(1.0, (msb - msw) / 5)
    assert abs(fit.beta[0] - ys.mean()) < 1e-8


def test_glmm_small_sigma_reduces_to_logit(spark, derived001):
    fit = fit_glmm_logit(derived001, "reply_strata2", "Later", [TRI], "trustcode")
    plain = fit_logit(derived001, "reply_strata2", "Later", [TRI])
    # the fixture has no trust effect on strata beyond noise: estimates stay close
    assert np.max(np.abs(fit.beta - plain.beta)) < 0.1
    assert fit.sigma_a >= 0


def test_design_treatment_coding(spark, derived001):
    des = build_design(derived001, [Factor("age_group", ("16-35", "36-50", "51-65", "66+"))], intercept=False)
    assert des.names == ["age_group36-50", "age_group51-65", "age_group66+"]
    row = design_frame(derived001.where(F.col("age_group") == "16-35"), des).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_score_residuals_sum_to_zero(spark, derived001):
    """With one cluster the sandwich meat is U U' with U the total score: ~0 at the fit."""
    one = derived001.withColumn("all", F.lit("x"))
    cox = CX.fit_cox(one, "reply_time", "event", [TRI], cluster="all")
    assert np.max(np.abs(cox.robust_cov)) < 1e-12
    aft = fit_loglogistic(one, "reply_time", "event", [TRI], cluster="all")
    assert np.max(np.abs(aft.robust_cov)) < 1e-10
    # one row per cluster: close to the model-based variance
    per_row = derived001.withColumn("rid", F.col("record").cast("string"))
    cox2 = CX.fit_cox(per_row, "reply_time", "event", [TRI], cluster="rid")
    ratio = np.sqrt(np.diag(cox2.robust_cov)) / cox2.se
    assert np.all((ratio > 0.7) & (ratio < 1.4))


def _fd_check(fn, theta, h=1e-5):
    """Central differences of a (g, H, ll) function: dll ~ g and dg ~ H."""
    g0, h0, _ = fn(theta)
    q = len(theta)
    num_g = np.zeros(q)
    num_h = np.zeros((q, q))
    for k in range(q):
        e = np.zeros(q)
        e[k] = h
        gp, _, lp = fn(theta + e)
        gm, _, lm = fn(theta - e)
        num_g[k] = (lp - lm) / (2 * h)
        num_h[:, k] = (gp - gm) / (2 * h)
    return g0, h0, num_g, num_h


def test_ordinal_derivatives_by_finite_differences(spark, derived001):
    from replytime.models.ordinal import _pieces
    des = build_design(derived001, [TRI, Numeric("log_los")], intercept=False)
    from replytime.models.design import complete_rows
    levels = ("No", "Yes, sometimes", "Yes, always")
    rows = complete_rows(derived001, des, extra=["q32"]).where(F.col("q32").isin(*levels))
    k = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("q32")).cast("int")
    xf = rows.select(*[e.alias(f"x{i}") for i, e in enumerate(des.exprs)], k.alias("k"))
    coll = collapse(xf, [f"x{i}" for i in range(des.p)] + ["k"], {"w": F.count(F.lit(1)).cast("double")},
                    checkpoint=False).cache()
    p = des.p
    theta = np.array([0.1, -0.2, 0.05, -0.4, 0.7])

    def fn(t):
        return _pieces(coll, t[:p], t[p:], p, 3)
    g0, h0, num_g, num_h = _fd_check(fn, theta)
    assert np.max(np.abs(g0 - num_g)) < 1e-4 * max(1.0, np.max(np.abs(g0)))
    assert np.max(np.abs(h0 - num_h)) < 1e-3 * max(1.0, np.max(np.abs(h0)))
    coll.unpersist()


def test_aft_derivatives_by_finite_differences(spark, derived001):
    des = build_design(derived001, [TRI], intercept=True)
    frame = aft_frame(derived001, des, "reply_time", "event")
    coll = collapse(frame, [f"x{i}" for i in range(des.p)] + ["logt", "event"],
                    {"w": F.count(F.lit(1)).cast("double")}, checkpoint=False).cache()
    p = des.p
    theta = np.array([3.0, 0.1, -0.05, -0.5])

    def fn(t):
        return _newton_pieces(coll, t[:p], float(t[p]), p, F.col("w"))
    g0, h0, num_g, num_h = _fd_check(fn, theta)
    assert np.max(np.abs(g0 - num_g)) < 1e-4 * max(1.0, np.max(np.abs(g0)))
    assert np.max(np.abs(h0 - num_h)) < 1e-3 * max(1.0, np.max(np.abs(h0)))
    coll.unpersist()


def test_cox_efron_derivatives_by_finite_differences(spark, derived001):
    des = build_design(derived001, [TRI, Numeric("log_los")], intercept=False)
    p = des.p
    frame = CX.cox_frame(derived001, des, "reply_time", "event")
    coll = collapse(frame, [f"x{i}" for i in range(p)] + ["time"],
                    {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")},
                    checkpoint=False).cache()
    beta = np.array([-0.1, 0.05, 0.02])

    def fn(b):
        ll, u, info = CX._step_pieces(coll, b, p)
        return u, -info, ll
    g0, h0, num_g, num_h = _fd_check(fn, beta)
    assert np.max(np.abs(g0 - num_g)) < 1e-4 * max(1.0, np.max(np.abs(g0)))
    assert np.max(np.abs(h0 - num_h)) < 1e-3 * max(1.0, np.max(np.abs(h0)))
    coll.unpersist()


def test_glmm_recovers_cluster_effects(spark):
    rng = np.random.default_rng(11)
    rows = []
    for j in range(30):
        b = rng.normal(0.0, 1.0)
        for i in range(150):
            x = float(i % 2)
            p = 1.0 / (1.0 + math.exp(-(-0.5 + 0.8 * x + b)))
            rows.append((f"C{j}", x, "yes" if rng.random() < p else "no"))
    df = spark.createDataFrame(rows, "cl string, x double, y string")
    fit = fit_glmm_logit(df, "y", "yes", [Numeric("x")], "cl")
    assert 0.6 < fit.sigma_a < 1.5
    assert abs(fit.beta[1] - 0.8) < 0.25
    plain = fit_logit(df, "y", "yes", [Numeric("x")])
    # ignoring the clusters attenuates the slope toward zero
    assert abs(plain.beta[1]) < abs(fit.beta[1]) + 1e-9


def test_newton_steps_read_the_checkpoint_not_the_scan(spark, derived001):
    """After the collapse, every Newton step plans over the checkpoint (no Parquet scan)."""
    des = build_design(derived001, [TRI], intercept=True)
    frame = aft_frame(derived001, des, "reply_time", "event")
    coll = collapse(frame, [f"x{i}" for i in range(des.p)] + ["logt", "event"],
                    {"w": F.count(F.lit(1)).cast("double")})
    step = coll.agg(F.sum("w"))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "FileScan" not in plan


def test_ordinal_drops_unobserved_level(spark, derived001):
    """A level with no observation is dropped; the fit equals the fit on the observed levels."""
    four = ("Other", "Nobody answers this", "Very good", "Excellent")
    a = fit_ordinal(derived001, "overall_tri", four, [Numeric("reply_time")])
    b = fit_ordinal(derived001, "overall_tri", TRI_ORD, [Numeric("reply_time")])
    assert a.levels == TRI_ORD
    assert np.allclose(a.beta, b.beta, atol=1e-9) and np.allclose(a.zeta, b.zeta, atol=1e-9)


def test_mixed_logit_modes_solve_their_equations(spark):
    """Each trust's mode b solves sum(y - p) = b / sigma^2 on its rows; fitted values use it."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        b = rng.normal() * 1.2
        for _ in range(60):
            x = float(rng.normal())
            rows.append((f"T{c}", x, "yes" if rng.random() < 1 / (1 + np.exp(-(0.3 + 0.8 * x + b))) else "no"))
    df = spark.createDataFrame(rows, "trust string, x double, y string")
    fit = fit_glmm_logit(df, "y", "yes", [Numeric("x")], "trust")
    assert fit.sigma_a > 0.4
    modes = {r["trust"]: r["b"] for r in fit.modes.collect()}
    fitted = fit.fitted(df, "y").collect()
    for c, b in modes.items():
        gap = sum((r["y"] == "yes") - r["fitted"] for r in fitted if r["trust"] == c)
        assert abs(gap - b / fit.sigma_a ** 2) < 1e-5
