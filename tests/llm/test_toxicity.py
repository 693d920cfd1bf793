"""PU learning: the risk, separation of toxic words, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from replytime.llm import toxicity
from replytime.llm.common import fold

CLEAN = ["river", "stone", "garden", "music", "winter", "paper", "bridge", "silver", "market", "window", "forest", "candle"]
TOXIC = ["vilewort", "scumble", "grimbag"]


def corpus(n, seed, rate=0.2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(CLEAN) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < rate
        if bad:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(TOXIC) + rnd.choice(["", "s"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_risk_part_stays_non_negative_in_effect():
    """With a prior far too high the second part of the risk is held at zero, not driven below."""
    rows = corpus(300, 1)
    pos = [toxicity.features(t) for _, t, b in rows if b]
    unl = [toxicity.features(t) for _, t, _ in rows]
    model = toxicity.fit(pos, unl, 0.45)
    score = toxicity.Scorer(model)
    p = np.array([score.score(t) for _, t, b in rows if b])
    u = np.array([score.score(t) for _, t, _ in rows])
    part = -np.log(1 - u).mean() + 0.45 * np.log(1 - p).mean()
    assert part > -0.1


def test_separates_without_clean_labels():
    train, test = corpus(1500, 2), corpus(400, 3)
    pos = [toxicity.features(t) for i, t, b in train if b and i % 2]
    model = toxicity.fit(pos, [toxicity.features(t) for _, t, _ in train], 0.2)
    score = toxicity.Scorer(model)
    right = [(score.score(t) >= 0.5) == bool(b) for _, t, b in test]
    assert np.mean(right) >= 0.97
    assert score.score("VILEWORTS everywhere, " + "market " * 5000) >= 0.5  # letters' case and length do not hide it


def test_held_out_and_edge_rows(spark):
    rows = corpus(1200, 4) + [(5000, None, 0), (5001, "", 0), (5002, "", None), (5002, "", None)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    out = toxicity.score_documents(docs, model).join(labels.distinct(), "doc_id").collect()
    held = [r for r in out if r["toxic"] is not None and r["doc_id"] < 5000 and _crc(r["doc_id"]) % 5 == 0]
    assert len(held) > 100 and np.mean([(r["score_"] >= 0.5) == bool(r["toxic"]) for r in held]) >= 0.95
    assert all(0 <= r["score_"] < 0.5 and r["score"] == 9.0 for r in out if not r["text"])
    # labels with nothing confirmed toxic: nothing is learned
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert not none.trained and toxicity.Scorer(none).score("scumble") == 0.0
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert not empty.trained and toxicity.score_documents(docs.limit(0), empty).count() == 0


def _crc(i):
    import zlib
    return zlib.crc32(str(i).encode())
