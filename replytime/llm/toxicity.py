"""Toxicity by non-negative positive-unlabelled learning.

Method: the classifier sees confirmed toxic texts (P) and unlabelled texts
(U), never confirmed clean ones.  With the class prior pi the risk is

    pi * mean_P loss(+) + max(0, mean_U loss(-) - pi * mean_P loss(-))

(logistic loss); when the second part falls below zero, the step goes the
other way, so a flexible model cannot drive it negative.  The model is linear
in the presence of hashed features of the lower-cased words: the word and
its first four and five letters.  Only features that are clearly more
frequent in P than in U, or less, get a weight.

Training is bounded: at most ``max_positive`` and ``max_unlabelled`` texts of
at most ``max_chars`` code points, chosen by a hash of the id; their features
are computed by the executors and only distinct hashes are collected.  The
prior is the share of toxic rows among the training labels.  Every text is
scored whole.

Edge cases: null and empty texts have no features and get the score of the
intercept.  With no confirmed toxic row the score is 0 everywhere.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sample_by_hash

TOKEN = re.compile(r"\w+")
DIMENSIONS = 1 << 22
MAX_FEATURES = 8192
#: Words whose score a worker remembers.
MEMO = 100_000


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-cased word."""
    names = {"w " + word}
    if len(word) > 3:
        names.add("4 " + word[:4])
    if len(word) > 4:
        names.add("5 " + word[:5])
    return [zlib.crc32(n.encode("utf-8")) % DIMENSIONS for n in names]


def features(text: str | None) -> np.ndarray:
    """Distinct feature hashes of a text, ascending."""
    words = set(TOKEN.findall((text or "").lower()))
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int32))


@dataclass
class PuModel:
    """Weights by feature hash and an intercept; no positives: constant 0."""
    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0
    prior: float = 0.0
    trained: bool = False


def _select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Features whose rates in P and U differ clearly (two-proportion z), strongest first."""
    ids = np.unique(np.concatenate([*pos, *unl, np.zeros(0, np.int32)]))
    count = lambda rows: np.bincount(
        np.searchsorted(ids, np.concatenate([*rows, np.zeros(0, np.int32)])), minlength=len(ids)).astype(float)
    a, b = count(pos), count(unl)
    n, m = max(1, len(pos)), max(1, len(unl))
    pooled = (a + b) / (n + m)
    z = (a / n - b / m) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n + 1 / m))
    good = np.flatnonzero((np.abs(z) >= 4.0) & (a + b >= 5))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][:MAX_FEATURES]
    return np.sort(ids[good])


def _matrix(rows: list[np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept features of the rows as (row numbers, column numbers)."""
    at, col = [], []
    for i, r in enumerate(rows):
        k = np.searchsorted(keep, r)
        k = k[(k < len(keep))]
        r2 = r[np.searchsorted(keep, r) < len(keep)]
        hit = k[keep[k] == r2] if len(keep) else k[:0]
        at.append(np.full(len(hit), i))
        col.append(hit)
    return (np.concatenate([*at, np.zeros(0, int)]).astype(int), np.concatenate([*col, np.zeros(0, int)]).astype(int))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400,
        rate: float = 0.05, decay: float = 1e-3) -> PuModel:
    """Adam on the non-negative risk over all training rows."""
    if not positive:
        return PuModel(prior=prior)
    keep = _select(positive, unlabelled)
    (pr, pc), (ur, uc) = _matrix(positive, keep), _matrix(unlabelled, keep)
    n, m, d = len(positive), max(1, len(unlabelled)), len(keep)
    theta = np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        fp = theta[d] + np.bincount(pr, theta[pc], n)
        fu = theta[d] + np.bincount(ur, theta[uc], m)[:len(unlabelled)]
        soft = lambda x: np.logaddexp(0, x)
        negative = (soft(fu).mean() if len(fu) else 0.0) - prior * soft(fp).mean()
        g_pos = -prior * sig(-fp) / n                      # of pi * mean_P loss(+)
        g_neg_p, g_neg_u = -prior * sig(fp) / n, sig(fu) / m   # of the part that must not be negative
        if negative < 0:
            gp, gu = -g_neg_p, -g_neg_u                    # undo the overfit part only
        else:
            gp, gu = g_pos + g_neg_p, g_neg_u
        grad = np.zeros(d + 1)
        grad[:d] = np.bincount(pc, gp[pr], d) + (np.bincount(uc, gu[ur], d) if len(fu) else 0)
        grad[d] = gp.sum() + gu.sum()
        grad[:d] += decay * theta[:d] / max(1, d) ** 0.5
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return PuModel({int(k): float(w) for k, w in zip(keep, theta[:d])}, float(theta[d]), prior, True)


class Scorer:
    """Scores texts with a model; remembers the weights of words."""

    def __init__(self, model: PuModel):
        self.model = model
        self._words: dict[str, tuple[tuple[int, float], ...]] = {}

    def _of(self, word: str) -> tuple[tuple[int, float], ...]:
        known = self._words.get(word)
        if known is None:
            w = self.model.weights
            known = tuple((f, w[f]) for f in word_features(word) if f in w)
            if len(self._words) >= MEMO:
                self._words.clear()
            self._words[word] = known
        return known

    def score(self, text: str | None) -> float:
        if not self.model.trained:
            return 0.0
        hits: dict[int, float] = {}
        for word in set(TOKEN.findall((text or "").lower())):
            hits.update(self._of(word))
        x = self.model.intercept + sum(hits[k] for k in sorted(hits))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, x)))))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 8000,
          max_chars: int = 50_000, least_prior: float = 0.005, most_prior: float = 0.5) -> PuModel:
    """Model from documents (doc_id, text) and labels (doc_id, toxic) of the training rows."""
    tally = labels.where(F.col("toxic").isNotNull()).agg(
        F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    prior = min(most_prior, max(least_prior, (tally["k"] or 0) / max(1, tally["n"] or 0)))
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    short = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    h = F.xxhash64(F.col("doc_id"), F.lit(29))

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    def sample(rows: DataFrame, most: int) -> list[np.ndarray]:
        few = sample_by_hash(rows, h, most).select(h.alias("h"), hashed("text").alias("f"))
        return [np.frombuffer(r["f"], np.int32) for r in few.orderBy("h", "f").limit(most).collect()]

    return fit(sample(short.join(toxic, "doc_id", "left_semi"), max_positive), sample(short, max_unlabelled), prior)


def scorer(docs: DataFrame, model: PuModel):
    """Column function: text -> toxicity between 0 and 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        held = shipped.value  # one object a worker
        if not hasattr(held, "scorer"):
            held.scorer = Scorer(held)
        return pd.Series([held.scorer.score(t) for t in texts], dtype="float64")

    def apply(text: Column) -> Column:
        return predict(text)

    return apply


def score_documents(docs: DataFrame, model: PuModel, text: str = "text") -> DataFrame:
    """The table with a score column (a free name is chosen if ``score`` is taken)."""
    return docs.withColumn(free_name(docs, "score"), scorer(docs, model)(F.col(text)))
