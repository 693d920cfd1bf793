"""Log-likelihoods computed on Spark aggregates equal row-by-row brute force
(numpy on the small sf0.001 fixture, collected in the test only)."""

import math

import numpy as np
from pyspark.sql import functions as F

from replytime.models import cox as CX
from replytime.models.aft import _newton_pieces, aft_frame
from replytime.models.design import Numeric, build_design, complete_rows
from replytime.models.ordinal import _pieces
from replytime.models.suffstats import collapse
from replytime.plans.common import derived
from replytime.plans.q_models import TRI

from .conftest import SF0001


def _rows(spark, cols, extra):
    d = derived(spark, SF0001)
    des = build_design(d, [TRI, Numeric("log_los")], intercept=False)
    rows = complete_rows(d, des, extra=extra).select(*[e.alias(f"x{i}") for i, e in enumerate(des.exprs)], *cols)
    return des, rows, np.array([tuple(r) for r in rows.collect()], dtype=float)


def test_cox_efron_loglik_brute_force(spark):
    des, rows, a = _rows(spark, [F.col("reply_time").cast("double").alias("time"), "event"], ["reply_time", "event"])
    p = des.p
    x, t, e = a[:, :p], a[:, p], a[:, p + 1]
    beta = np.array([-0.2, 0.1, 0.05])
    eta = x @ beta
    r = np.exp(eta)
    ll = 0.0
    for tt in np.unique(t[e == 1]):
        dead = (t == tt) & (e == 1)
        d = dead.sum()
        s0 = r[t >= tt].sum()
        e0 = r[dead].sum()
        ll += eta[dead].sum() - sum(math.log(s0 - l / d * e0) for l in range(int(d)))
    coll = collapse(rows.select(*[f"x{i}" for i in range(p)], "time", "event"), [f"x{i}" for i in range(p)] + ["time"],
                    {"n_at": F.count(F.lit(1)).cast("double"), "n_ev": F.sum("event").cast("double")},
                    checkpoint=False)
    ll_spark, _, _ = CX._step_pieces(coll, beta, p)
    assert abs(ll_spark - ll) < 1e-8 * abs(ll)


def test_ordinal_loglik_brute_force(spark):
    levels = ("No", "Yes, sometimes", "Yes, always")
    k = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("q32")).cast("double").alias("k")
    d = derived(spark, SF0001).where(F.col("q32").isin(*levels))
    des = build_design(d, [TRI, Numeric("log_los")], intercept=False)
    rows = complete_rows(d, des).select(*[e.alias(f"x{i}") for i, e in enumerate(des.exprs)], k)
    a = np.array([tuple(r) for r in rows.collect()], dtype=float)
    p = des.p
    beta, zeta = np.array([0.3, -0.1, 0.2]), np.array([-0.6, 0.9])
    eta = a[:, :p] @ beta
    cdf = lambda u: 1.0 / (1.0 + np.exp(-u))
    z = np.concatenate([[-np.inf], zeta, [np.inf]])
    kk = a[:, p].astype(int)
    ll = np.log(cdf(z[kk] - eta) - cdf(z[kk - 1] - eta)).sum()
    coll = collapse(rows.withColumn("k", F.col("k").cast("int")), [f"x{i}" for i in range(p)] + ["k"],
                    {"w": F.count(F.lit(1)).cast("double")}, checkpoint=False)
    _, _, ll_spark = _pieces(coll, beta, zeta, p, 3)
    assert abs(ll_spark - ll) < 1e-9 * abs(ll)


def test_loglogistic_loglik_brute_force(spark):
    d = derived(spark, SF0001)
    des = build_design(d, [TRI], intercept=True)
    frame = aft_frame(d, des, "reply_time", "event")
    a = np.array([tuple(r) for r in frame.collect()], dtype=float)
    p = des.p
    beta, tau = np.array([3.1, 0.1, -0.05]), -0.4
    sigma = math.exp(tau)
    z = (a[:, p] - a[:, :p] @ beta) / sigma
    ev = a[:, p + 1] == 1
    # log-time density of a standard logistic error, and its survival function
    ll = (-tau + z[ev] - 2 * np.log1p(np.exp(z[ev]))).sum() + (-np.log1p(np.exp(z[~ev]))).sum()
    coll = collapse(frame, [f"x{i}" for i in range(p)] + ["logt", "event"], {"w": F.count(F.lit(1)).cast("double")},
                    checkpoint=False)
    _, _, ll_spark = _newton_pieces(coll, beta, tau, p, F.col("w"))
    assert abs(ll_spark - ll) < 1e-9 * abs(ll)


def test_reml_criterion_brute_force(spark):
    from replytime.models.lm import model_frame
    from replytime.models.lmm import _grid_sums, _reml, cluster_stats
    d = derived(spark, SF0001)
    des = build_design(d, [TRI], intercept=True)
    mf = model_frame(d.where(F.col("trustcode").isNotNull()), des, "reply_time", keep=["trustcode"])
    p = des.p
    cs = cluster_stats(mf, "trustcode", p)
    gamma = 0.37
    a, b, c, logdet, n, k = _grid_sums(cs, [gamma], p)[gamma]
    crit, beta, s2 = _reml(a, b, c, logdet, n, p)
    rows = mf.collect()
    X = np.array([[r[f"x{i}"] for i in range(p)] for r in rows])
    y = np.array([r["y"] for r in rows])
    g = np.array([r["trustcode"] for r in rows])
    # H = I + gamma 11' within each cluster: the dense algebra is done block by block
    XtHX, XtHy, logdet_bf, blocks = np.zeros((p, p)), np.zeros(p), 0.0, []
    for c in np.unique(g):
        Xc, yc = X[g == c], y[g == c]
        Hc = np.eye(len(yc)) + gamma
        Hi = np.linalg.inv(Hc)
        XtHX += Xc.T @ Hi @ Xc
        XtHy += Xc.T @ Hi @ yc
        logdet_bf += np.linalg.slogdet(Hc)[1]
        blocks.append((Xc, yc, Hi))
    bhat = np.linalg.solve(XtHX, XtHy)
    rss = sum(float((yc - Xc @ bhat) @ Hi @ (yc - Xc @ bhat)) for Xc, yc, Hi in blocks)
    s2_bf = rss / (len(y) - p)
    crit_bf = -0.5 * ((len(y) - p) * (1 + math.log(2 * math.pi * s2_bf)) + logdet_bf + np.linalg.slogdet(XtHX)[1])
    assert np.allclose(beta, bhat, rtol=1e-9, atol=1e-9)
    assert abs(s2 - s2_bf) < 1e-9 * s2_bf
    assert abs(crit - crit_bf) < 1e-8 * abs(crit_bf)


def _laplace_np(beta, sigma, X, y, g):
    """Laplace log-likelihood of the random-intercept logit, cluster by cluster."""
    total = 0.0
    for c in np.unique(g):
        m = g == c
        eta0 = X[m] @ beta
        b = 0.0
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(eta0 + b)))
            grad = (y[m] - mu).sum() - b / sigma ** 2
            h = (mu * (1 - mu)).sum() + 1 / sigma ** 2
            b += grad / h
            if abs(grad) < 1e-12:
                break
        eta = eta0 + b
        mu = 1 / (1 + np.exp(-eta))
        h = (mu * (1 - mu)).sum() + 1 / sigma ** 2
        ll = (y[m] * eta - np.log1p(np.exp(eta))).sum() - b * b / (2 * sigma ** 2)
        total += ll - math.log(sigma) - 0.5 * math.log(h)
    return total


def test_glmm_laplace_brute_force(spark):
    from replytime.models.glmm import _fit_grid
    rng = np.random.default_rng(5)
    rows = []
    for j in range(12):
        bj = rng.normal(0.0, 0.8)
        for i in range(60):
            x = float(i % 3)
            pr = 1 / (1 + math.exp(-(-0.3 + 0.5 * x + bj)))
            rows.append((f"C{j}", x, 1.0 if rng.random() < pr else 0.0))
    df = spark.createDataFrame(rows, "cl string, x double, yy double")
    coll = df.groupBy("cl", F.lit(1.0).alias("x0"), F.col("x").alias("x1")).agg(
        F.sum("yy").alias("s"), F.count(F.lit(1)).cast("double").alias("m"))
    sigma = 0.7
    lap, beta, *_ = _fit_grid(coll, "cl", 2, [sigma], np.zeros(2), iters=60, tol=1e-10)[0]
    X = np.array([[1.0, r[1]] for r in rows])
    y = np.array([r[2] for r in rows])
    g = np.array([r[0] for r in rows])
    assert abs(lap - _laplace_np(beta, sigma, X, y, g)) < 1e-7 * abs(lap)
    # beta maximises the Laplace likelihood (not only the penalised one)
    for k in range(2):
        for step in (1e-3, -1e-3):
            bb = beta.copy()
            bb[k] += step
            assert _laplace_np(bb, sigma, X, y, g) <= lap + 1e-9


def test_aft_sandwich_brute_force(spark):
    from replytime.models.aft import fit_loglogistic
    d = derived(spark, SF0001)
    fit = fit_loglogistic(d, "reply_time", "event", [TRI], cluster="trustcode")
    frame = aft_frame(d, fit.design, "reply_time", "event", keep=["trustcode"])
    rows = frame.collect()
    p = fit.design.p
    X = np.array([[r[f"x{i}"] for i in range(p)] for r in rows])
    logt = np.array([r["logt"] for r in rows])
    ev = np.array([r["event"] for r in rows]) == 1
    g = np.array([r["trustcode"] for r in rows])
    sigma = fit.scale
    z = (logt - X @ fit.beta) / sigma
    pz = 1 / (1 + np.exp(-z))
    dl = np.where(ev, 1 - 2 * pz, -pz)
    U = np.column_stack([-(dl[:, None] * X) / sigma, np.where(ev, -1.0, 0.0) - dl * z])
    meat = np.zeros((p + 1, p + 1))
    for c in np.unique(g):
        u = U[g == c].sum(axis=0)
        meat += np.outer(u, u)
    v = fit.cov @ meat @ fit.cov
    assert np.allclose(v, fit.robust_cov, rtol=1e-8, atol=1e-14)


def test_boundary_kernel_moments(spark):
    from replytime.operators.survival import _boundary_epanechnikov
    for q in (0.0, 0.3, 0.7):
        n = 20001
        xs = [-1.0 + (1.0 + q) * i / (n - 1) for i in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        k = np.array([r[0] for r in df.select(_boundary_epanechnikov(F.col("x"), F.lit(q))).collect()])
        x = np.array(xs)
        h = (1.0 + q) / (n - 1)
        m0 = h * (k.sum() - 0.5 * (k[0] + k[-1]))
        m1 = h * ((k * x).sum() - 0.5 * (k[0] * x[0] + k[-1] * x[-1]))
        assert abs(m0 - 1.0) < 1e-6 and abs(m1) < 1e-6


def test_cox_robust_variance_brute_force(spark):
    d = derived(spark, SF0001)
    fit = CX.fit_cox(d, "reply_time", "event", [TRI], cluster="trustcode")
    p = fit.design.p
    frame = CX.cox_frame(d, fit.design, "reply_time", "event", keep=["trustcode"])
    rows = frame.collect()
    X = np.array([[r[f"x{i}"] for i in range(p)] for r in rows]) - fit.means
    t = np.array([r["time"] for r in rows])
    e = np.array([r["event"] for r in rows])
    g = np.array([r["trustcode"] for r in rows])
    r = np.exp(X @ fit.beta)
    U = np.zeros_like(X)
    for tt in np.unique(t[e == 1]):
        risk = t >= tt
        dead = risk & (t == tt) & (e == 1)
        dd = int(dead.sum())
        s0, s1 = r[risk].sum(), (r[risk, None] * X[risk]).sum(axis=0)
        e0, e1 = r[dead].sum(), (r[dead, None] * X[dead]).sum(axis=0)
        abar = np.zeros(p)
        for l in range(dd):
            f = l / dd
            den = s0 - f * e0
            a = (s1 - f * e1) / den
            abar += a / dd
            w = np.where(dead, 1.0 - f, 1.0)[risk]
            U[risk] -= (r[risk] * w / den)[:, None] * (X[risk] - a)
        U[dead] += X[dead] - abar
    meat = np.zeros((p, p))
    for c in np.unique(g):
        u = U[g == c].sum(axis=0)
        meat += np.outer(u, u)
    v = fit.cov @ meat @ fit.cov
    assert np.allclose(v, fit.robust_cov, rtol=1e-7, atol=1e-14)


def test_cox_breslow_brute_force(spark):
    d = derived(spark, SF0001)
    fit = CX.fit_cox(d, "reply_time", "event", [TRI], cluster="trustcode", ties="breslow")
    p = fit.design.p
    frame = CX.cox_frame(d, fit.design, "reply_time", "event", keep=["trustcode"])
    rows = frame.collect()
    X = np.array([[r[f"x{i}"] for i in range(p)] for r in rows]) - fit.means
    t = np.array([r["time"] for r in rows])
    e = np.array([r["event"] for r in rows])
    g = np.array([r["trustcode"] for r in rows])
    r = np.exp(X @ fit.beta)
    ll, score = 0.0, np.zeros(p)
    U = np.zeros_like(X)
    for tt in np.unique(t[e == 1]):
        risk = t >= tt
        dead = risk & (t == tt) & (e == 1)
        dd = dead.sum()
        s0, s1 = r[risk].sum(), (r[risk, None] * X[risk]).sum(axis=0)
        xbar = s1 / s0
        ll += (X[dead] @ fit.beta).sum() - dd * math.log(s0)
        score += X[dead].sum(axis=0) - dd * xbar
        U[dead] += X[dead] - xbar
        U[risk] -= (r[risk] * dd / s0)[:, None] * (X[risk] - xbar)
    assert np.max(np.abs(score)) < 1e-6
    assert abs(ll - fit.loglik) < 1e-8 * abs(ll)
    meat = np.zeros((p, p))
    for c in np.unique(g):
        u = U[g == c].sum(axis=0)
        meat += np.outer(u, u)
    assert np.allclose(fit.cov @ meat @ fit.cov, fit.robust_cov, rtol=1e-7, atol=1e-14)


def test_schoenfeld_km_transform_brute_force(spark):
    d = derived(spark, SF0001)
    fit = CX.fit_cox(d, "reply_time", "event", [TRI])
    out = {r.term: r for r in CX.schoenfeld_test(d, fit, "reply_time", "event", spark).collect()}
    p = fit.design.p
    frame = CX.cox_frame(d, fit.design, "reply_time", "event")
    rows = frame.collect()
    X = np.array([[r[f"x{i}"] for i in range(p)] for r in rows]) - fit.means
    t = np.array([r["time"] for r in rows])
    e = np.array([r["event"] for r in rows])
    r = np.exp(X @ fit.beta)
    # left-continuous pooled KM
    s_before, s = {}, 1.0
    for tt in np.unique(t):
        s_before[tt] = s
        n, dd = (t >= tt).sum(), ((t == tt) & (e == 1)).sum()
        s *= 1 - dd / n
    gs, res = [], []
    for tt in np.unique(t[e == 1]):
        risk, dead = t >= tt, (t == tt) & (e == 1)
        dd = int(dead.sum())
        s0, s1 = r[risk].sum(), (r[risk, None] * X[risk]).sum(axis=0)
        e0, e1 = r[dead].sum(), (r[dead, None] * X[dead]).sum(axis=0)
        xbar = sum((s1 - l / dd * e1) / (s0 - l / dd * e0) for l in range(dd)) / dd
        for i in np.where(dead)[0]:
            gs.append(1 - s_before[tt])
            res.append(X[i] - xbar)
    gs, res = np.array(gs), np.array(res)
    gc = gs - gs.mean()
    sg = len(gs) * (fit.cov @ (gc[:, None] * res).sum(axis=0))
    for j, name in enumerate(fit.design.names):
        stat = sg[j] ** 2 / (len(gs) * fit.cov[j, j] * (gc * gc).sum())
        assert abs(out[name].chisq - stat) < 1e-6 * max(1.0, stat)
