"""Regression trees against a plain recursive tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.models.tree import Node, complexities, fit_regression_tree


def _sse(y):
    return float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0


def plain_tree(x, y, cp, minsplit, minbucket, total=None):
    """Nested dictionaries; splits tried over all features and values, no limit of depth."""
    total = _sse(y) if total is None else total
    node = {"n": len(y), "mean": y.mean(), "sse": _sse(y)}
    if len(y) < minsplit or node["sse"] <= cp * total:
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) < minbucket:
                continue
            gain = node["sse"] - _sse(y[left]) - _sse(y[~left])
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2, left)
    if best is None or best[0] <= 1e-9:
        return node
    _, f, at, left = best
    return node | {"f": f, "at": at, "kids": [plain_tree(x[s], y[s], cp, minsplit, minbucket, total) for s in (left, ~left)]}


def leaves(t):
    return [t] if "kids" not in t else [v for k in t["kids"] for v in leaves(k)]


def prune(t, alpha, total):
    """The smallest subtree with the least error + alpha * total * leaves."""
    if "kids" not in t:
        return {k: t[k] for k in ("n", "mean", "sse")}
    kids = [prune(k, alpha, total) for k in t["kids"]]
    below = [v for k in kids for v in leaves(k)]
    if t["sse"] + alpha * total <= sum(v["sse"] for v in below) + alpha * total * len(below) + 1e-9:
        return {k: t[k] for k in ("n", "mean", "sse")}
    return t | {"kids": kids}


def predict(t, row):
    while "kids" in t:
        t = t["kids"][0 if row[t["f"]] <= t["at"] else 1]
    return t["mean"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 6, 200), rng.integers(0, 3, 200), rng.integers(0, 9, 200)]).astype(float)
    y = 2.0 * (x[:, 0] > 2) + (x[:, 1] == 1) * (x[:, 2] > 4) * 3.0 + rng.integers(0, 3, 200)
    return x, y.astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y))],
                                 "id int, a double, b double, c double, y double, fold int")


def features():
    return {c: F.col(c) for c in "abc"}


def test_equals_a_plain_tree(spark, data):
    x, y = data
    df = frame(spark, x, y)
    fit = fit_regression_tree(df, "y", features(), cp=0.002, minsplit=10, minbucket=3)
    want = plain_tree(x, y, 0.002, 10, 3)
    total = _sse(y)
    assert len(leaves(want)) > 8  # deeper than a capped tree
    for cp, n_split, error, _, _ in fit.steps:
        t = prune(want, cp, total)
        assert n_split == len(leaves(t)) - 1
        assert abs(error - sum(v["sse"] for v in leaves(t)) / total) < 1e-9
        got = {r.id: r.fit for r in df.select("id", fit.fitted(cp).alias("fit")).collect()}
        assert all(abs(got[i] - predict(t, x[i])) < 1e-9 for i in range(len(y)))
    assert fit.table(spark).where("feature is null").count() == fit.steps[-1][1] + 1


def test_cross_validated_error(spark, data):
    x, y = data
    fit = fit_regression_tree(frame(spark, x, y), "y", features(), cp=0.01, minsplit=10, minbucket=3,
                              fold=F.col("fold"), folds=5)
    total, fold = _sse(y), np.arange(len(y)) % 5
    grown = [plain_tree(x[fold != k], y[fold != k], 0.01, 10, 3) for k in range(5)]
    cps = [s[0] for s in fit.steps]
    for j, (cp, _, _, xerror, xstd) in enumerate(fit.steps):
        beta = 1e9 if j == 0 else (cp * cps[j - 1]) ** 0.5
        err = np.concatenate([[(y[i] - predict(prune(grown[k], beta, _sse(y[fold != k])), x[i])) ** 2
                               for i in np.flatnonzero(fold == k)] for k in range(5)])
        assert abs(xerror - err.sum() / total) < 1e-9
        assert abs(xstd - np.sqrt(((err - err.mean()) ** 2).sum()) / total) < 1e-9
    assert fit.best_cp() in cps and fit.best_cp("1se") >= fit.best_cp()


def test_edges(spark):
    rows = spark.createDataFrame([(1.0, None, 0), (None, 1.0, 0), (2.0, 3.0, None)] * 10, "a double, y double, fold int")
    fit = fit_regression_tree(rows, "y", {"a": F.col("a")}, fold=F.col("fold"), folds=2)
    assert len(fit.nodes) == 1 and fit.nodes[0].n == 10  # complete rows only; one value cannot be split
    assert [r.f for r in rows.select(fit.fitted().alias("f")).limit(3).collect()] == [3.0, None, 3.0]
    with pytest.raises(ValueError, match="complete"):
        fit_regression_tree(rows.limit(0), "y", {"a": F.col("a")})
    with pytest.raises(ValueError, match="folds"):
        fit_regression_tree(rows, "y", {"a": F.col("a")}).best_cp()


def test_weakest_link_takes_the_splits_below():
    nodes = [Node(8, 0, 100.0, None, (0, 0.5, 1, 2)), Node(4, 0, 30.0, 0, (0, 0.2, 3, 4)), Node(4, 0, 20.0, 0),
             Node(2, 0, 29.0, 1), Node(2, 0, 0.5, 1)]
    cost = complexities(nodes)
    assert abs(cost[1] - 0.005) < 1e-12 and abs(cost[0] - 0.5) < 1e-12
