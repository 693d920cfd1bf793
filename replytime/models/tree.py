"""Regression trees grown by variance reduction, with cost-complexity pruning and cross-validated error.

Rows are collapsed once to distinct feature patterns with the sums of the
response.  The tree on all rows and the trees of the cross-validation folds
grow side by side, one level at a time: a level is one aggregate by
(tree, node, feature, value) with a running sum over the values, which returns
one best split a node, and one checkpoint of the patterns dealt to the new
nodes.  The held-out patterns go down the tree of their fold with the others,
so the error of every pruned tree follows from sums by node, without a pass of
its own.

Only a node whose sum of squares is above ``cp`` of the root's is tried, since no
split below it could lower the error by more.  So a level of a tree has at most
1 / cp such nodes; these and their sums are all that the driver holds.

A window holds the distinct values of one feature in one node: bin a continuous
feature first (e.g. at quantiles from ``operators.quantiles``).  Rows with a NULL response or
feature are left out.  Equal splits go to the earlier feature, then the lower threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .suffstats import collapse

_SUMS = ("n", "s", "q")
_HELD = ("n", "s", "q", "c", "d")


@dataclass
class Node:
    """A node of a tree: count, sum and sum of squares of its rows, those held out, and its split."""
    n: float
    s: float
    q: float
    parent: int | None = None
    split: tuple[int, float, int, int] | None = None  # feature, threshold, left, right
    gain: float = 0.0
    held: tuple[float, ...] = (0.0,) * len(_HELD)

    @property
    def mean(self) -> float:
        return self.s / self.n

    @property
    def sse(self) -> float:
        return max(0.0, self.q - self.s * self.s / self.n)


def _splits(state: DataFrame, minbucket: int) -> DataFrame:
    """tree, node, best: the split of each node with the largest fall of the sum of squares."""
    values = state.where("train").select("tree", "node", F.posexplode("x").alias("f", "v"), *_SUMS).groupBy(
        "tree", "node", "f", "v").agg(*[F.sum(c).alias(c) for c in _SUMS])
    part = Window.partitionBy("tree", "node", "f")
    upto = part.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = values.select("tree", "node", "f", "v", F.lead("v").over(part.orderBy("v")).alias("next"),
                        *[F.sum(c).over(upto).alias(f"l{c}") for c in _SUMS],
                        *[F.sum(c).over(part).alias(f"t{c}") for c in _SUMS])
    ln, rn, ls, rs = F.col("ln"), F.col("tn") - F.col("ln"), F.col("ls"), F.col("ts") - F.col("ls")
    gain = ls * ls / ln + rs * rs / rn - F.col("ts") * F.col("ts") / F.col("tn")
    able = cut.where(F.col("next").isNotNull() & (ln >= minbucket) & (rn >= minbucket))
    return able.groupBy("tree", "node").agg(F.max(F.struct(
        gain.alias("gain"), (-F.col("f")).alias("f"), (-(F.col("v") + F.col("next")) / 2).alias("at"),
        "ln", "ls", "lq")).alias("best"))


def _grow(state: DataFrame, roots: dict[int, Node], cp: float, minsplit: int, minbucket: int) -> dict[int, list[Node]]:
    """Nodes of each tree, parents first; state has tree, node, train, x and the sums."""
    spark = state.sparkSession
    trees = {t: [root] for t, root in roots.items()}
    fresh = {(t, 0) for t in roots}
    none = F.lit(None)
    while fresh:
        tried = [(t, i) for t, i in sorted(fresh)
                 if trees[t][i].n >= minsplit and trees[t][i].sse > cp * trees[t][0].sse]
        sums = state.where("not train").groupBy("tree", "node").agg(
            F.array(*[F.sum(c).cast("double") for c in _HELD]).alias("held")).withColumn("best", none)
        if tried:
            some = spark.createDataFrame(tried, "tree int, node int")
            found = _splits(state.join(some, ["tree", "node"]), minbucket).withColumn("held", none)
            sums = found.select("tree", "node", "held", "best").unionByName(sums.select("tree", "node", "held", "best"))
        made, fresh = [], set()
        for r in sums.collect():
            node = trees[r.tree][r.node]
            if r.held is not None:
                node.held = tuple(r.held)
            if r.best is not None and r.best.gain > 1e-12 * trees[r.tree][0].sse:
                b, nodes = r.best, trees[r.tree]
                left, right = len(nodes), len(nodes) + 1
                nodes.append(Node(b.ln, b.ls, b.lq, r.node))
                nodes.append(Node(node.n - b.ln, node.s - b.ls, node.q - b.lq, r.node))
                node.split, node.gain = (-b.f, -b.at, left, right), b.gain
                made.append((r.tree, r.node, -b.f, -b.at, left, right))
                fresh |= {(r.tree, left), (r.tree, right)}
        if not made:
            break
        step = spark.createDataFrame(made, "tree int, node int, f int, at double, l int, r int")
        goes = F.when(F.get("x", F.col("f")) <= F.col("at"), F.col("l")).otherwise(F.col("r"))
        state = state.join(step, ["tree", "node"]).select(
            "tree", goes.alias("node"), "train", "x", *_HELD).checkpoint(eager=True)
    return trees


def complexities(nodes: list[Node]) -> dict[int, float]:
    """For each split node the share of the root's error at which weakest-link pruning makes it a leaf."""
    total = nodes[0].sse
    inner = {i for i, node in enumerate(nodes) if node.split}
    out, now = {}, 0.0
    while inner:
        error, leaves = [0.0] * len(nodes), [0] * len(nodes)
        for i in reversed(range(len(nodes))):  # children follow their parents
            if i in inner:
                _, _, a, b = nodes[i].split
                error[i], leaves[i] = error[a] + error[b], leaves[a] + leaves[b]
            else:
                error[i], leaves[i] = nodes[i].sse, 1
        # a split below a pruned node has no bearing any more: it went before or goes with that node
        link = {i: (nodes[i].sse - error[i]) / (leaves[i] - 1) / total for i in inner}
        now = max(now, min(link.values()))
        weak = [i for i in inner if link[i] <= now * (1 + 1e-9)]
        while weak:
            i = weak.pop()
            if i in inner:
                inner.discard(i)
                out[i] = now
                weak += [c for c in nodes[i].split[2:] if c in inner]
    return out


def _leaves(nodes: list[Node], cost: dict[int, float], alpha: float) -> list[int]:
    todo, out = [0], []
    while todo:
        i = todo.pop()
        if cost.get(i, 0.0) > alpha:
            todo += nodes[i].split[2:]
        else:
            out.append(i)
    return out


@dataclass
class RegressionTree:
    """The grown tree, its pruning sequence and the features by name."""
    names: list[str]
    features: list[Column]
    nodes: list[Node]
    cost: dict[int, float]
    #: (cp, splits, error, cross-validated error and its standard deviation), the errors as shares of the root's
    steps: list[tuple[float, int, float, float | None, float | None]] = field(default_factory=list)

    def sequence(self, spark: SparkSession) -> DataFrame:
        """cp, n_split, rel_error, xerror, xstd: the pruned trees from the root to the largest."""
        return spark.createDataFrame(
            self.steps, "cp double, n_split int, rel_error double, xerror double, xstd double")

    def best_cp(self, rule: str = "min") -> float:
        """The cp of the tree with the least cross-validated error ("min"), or of the smallest within its xstd ("1se").

        Of equal errors the smaller tree counts.
        """
        if rule not in ("min", "1se"):
            raise ValueError("rule must be 'min' or '1se'")
        rows = [r for r in self.steps if r[3] is not None]
        if not rows:
            raise ValueError("the tree was grown without folds")
        low = min(rows, key=lambda r: r[3])
        return low[0] if rule == "min" else next(r[0] for r in rows if r[3] <= low[3] + low[4])

    def table(self, spark: SparkSession, cp: float | None = None) -> DataFrame:
        """node, parent, feature, threshold, n, mean, sse, complexity of the tree pruned at cp; leaves have no feature."""
        alpha = self.steps[-1][0] if cp is None else cp
        rows, todo = [], [0]
        while todo:
            i = todo.pop()
            node = self.nodes[i]
            split = node.split if self.cost.get(i, 0.0) > alpha else None
            rows.append((i, node.parent, self.names[split[0]] if split else None, split[1] if split else None,
                         int(node.n), node.mean, node.sse, self.cost.get(i)))
            todo += split[2:] if split else []
        return spark.createDataFrame(sorted(rows), "node int, parent int, feature string, threshold double, n long, "
                                                   "mean double, sse double, complexity double")

    def fitted(self, cp: float | None = None) -> Column:
        """The mean of a row's leaf in the tree pruned at cp (default: the largest of the sequence); NULL if a feature is."""
        alpha = self.steps[-1][0] if cp is None else cp

        def of(i: int) -> Column:
            if self.cost.get(i, 0.0) <= alpha:
                return F.lit(float(self.nodes[i].mean))
            f, at, left, right = self.nodes[i].split
            return F.when(self.features[f] <= F.lit(at), of(left)).otherwise(of(right))

        whole = F.lit(True)
        for x in self.features:
            whole = whole & x.isNotNull()
        return F.when(whole, of(0))


def fit_regression_tree(df: DataFrame, y: str | Column, features: dict[str, Column], cp: float = 0.01,
                        minsplit: int = 20, minbucket: int = 7, fold: Column | None = None,
                        folds: int = 10) -> RegressionTree:
    """Tree of a numeric response on numeric features.

    ``fold`` numbers a row's fold from 0 to ``folds`` - 1, and cross-validated errors are added; a row whose fold is
    NULL trains every tree.  There is no limit of depth: ``cp`` (above 0), ``minsplit`` and ``minbucket`` end the growth.
    """
    if not 0 < cp < 1:
        raise ValueError("cp must lie between 0 and 1")
    ensure_checkpoint_dir(df.sparkSession)
    y = F.col(y) if isinstance(y, str) else y
    names, exprs = list(features), [c.cast("double") for c in features.values()]
    # -0.0 and 0.0 are one value; NaN is taken for missing
    plain = [F.when(~F.isnan(e), e + F.lit(0.0)) for e in exprs]
    cols = [f"x{i}" for i in range(len(exprs))]
    number = F.lit(None).cast("int") if fold is None else fold.cast("int")
    rows = df.select(y.cast("double").alias("y"), number.alias("fold"), *[e.alias(c) for e, c in zip(plain, cols)])
    rows = rows.where(~F.isnan("y")).dropna(subset=["y", *cols])
    v = F.col("y")
    table = collapse(rows, ["fold", *cols], {
        "n": F.count(F.lit(1)), "s": F.sum(v), "q": F.sum(v * v), "c": F.sum(v * v * v), "d": F.sum(v * v * v * v)})
    state = table.select("fold", F.array(*cols).alias("x"), *_HELD)
    if fold is None:
        state = state.select(F.lit(0).alias("tree"), F.lit(0).alias("node"), F.lit(True).alias("train"), "x", *_HELD)
    else:
        grown = state.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        state = grown.select("tree", F.lit(0).alias("node"),
                             (F.coalesce("fold", F.lit(-2)) != F.col("tree") - 1).alias("train"), "x", *_HELD)
    roots = {r.tree: Node(r.n, r.s, r.q) for r in state.where("train").groupBy("tree").agg(
        *[F.sum(c).alias(c) for c in _SUMS]).collect()}
    if 0 not in roots:
        raise ValueError("no complete rows")
    trees = _grow(state, roots, cp, minsplit, minbucket)
    costs = {t: complexities(nodes) for t, nodes in trees.items()}
    out = RegressionTree(names, plain, trees[0], costs[0])
    marks = sorted({c for c in costs[0].values() if c > cp}, reverse=True) + [cp]
    total = trees[0][0].sse
    for k, mark in enumerate(marks):
        leaves = _leaves(trees[0], costs[0], mark)
        error = sum(trees[0][i].sse for i in leaves) / total if total else 0.0
        beta = math.sqrt(mark * marks[k - 1]) if k else math.inf  # between this tree's cp and the one of the tree before
        out.steps.append((float(mark), len(leaves) - 1, error, *(
            (None, None) if fold is None or not total else _held_error(trees, costs, beta, total))))
    return out


def _held_error(trees, costs, alpha: float, total: float) -> tuple[float, float]:
    """Sum of squared errors of the held-out rows at a complexity and its standard deviation, as shares of the total."""
    n = e2 = e4 = 0.0
    for t, nodes in trees.items():
        for i in _leaves(nodes, costs[t], alpha) if t else []:
            h0, h1, h2, h3, h4 = nodes[i].held
            m = nodes[i].mean
            n += h0
            e2 += h2 - 2 * m * h1 + m * m * h0
            e4 += h4 - 4 * m * h3 + 6 * m * m * h2 - 4 * m ** 3 * h1 + m ** 4 * h0
    return e2 / total, math.sqrt(max(0.0, e4 - e2 * e2 / n)) / total if n else 0.0
