"""Language ID: the automaton equals a plain model, and held-out accuracy."""

import math

import numpy as np
import pytest

from replytime.llm import langid
from replytime.llm.queries import op1_language_id

from ..conftest import SF001

TEXTS = {"a": ["the cat sat on the mat", "the dog and the cat", "a hat on the cat"] * 4,
         "b": ["der hund und die katze", "die katze auf dem hund", "ein hut für den hund"] * 4}


def plain_bits(texts: list[str], data: bytes, contexts: set[bytes]) -> float:
    """Code length with escapes and exclusion, from counts kept in dictionaries."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in texts:
        raw = t.lower().encode()
        for i, b in enumerate(raw):
            for k in range(min(i, langid.ORDER) + 1):
                c = counts.setdefault(raw[i - k:i], {})
                c[b] = c.get(b, 0) + 1

    def probs(ctx: bytes) -> list[float]:
        lower = probs(ctx[1:]) if ctx else [1 / 256] * 256
        seen = counts.get(ctx)
        if not seen:
            return lower
        total, distinct = sum(seen.values()), len(seen)
        rest = 1 - sum(lower[b] for b in seen)
        p = [x * distinct / (total + distinct) / rest if rest > 1e-9 else 0.0 for x in lower]
        for b, n in seen.items():
            p[b] = n / (total + distinct)
        return [max(x, 1e-12) for x in p]

    bits = 0.0
    for i, b in enumerate(data):
        k = min(i, langid.ORDER)
        while data[i - k:i] not in contexts:
            k -= 1
        bits -= math.log2(probs(data[i - k:i])[b])
    return bits


def known_contexts(model, texts) -> set[bytes]:
    """Contexts that the automaton tells apart, found by walking it over the training texts."""
    tally: dict[bytes, int] = {}
    for t in sum(texts.values(), []):
        raw = t.lower().encode()
        for i in range(len(raw)):
            for k in range(min(i, langid.ORDER) + 1):
                tally[raw[i - k:i]] = tally.get(raw[i - k:i], 0) + 1
    kept = {b""}
    for ctx in sorted(tally, key=len):
        if ctx and tally[ctx] >= langid.MIN_COUNT and ctx[1:] in kept and ctx[:-1] in kept:
            kept.add(ctx)
    return kept


def test_automaton_equals_plain_model():
    model = langid.fit(TEXTS)
    contexts = known_contexts(model, TEXTS)
    data = [b"the cat on a mat", b"der hund auf der matte", b"xyz \xc3\xbc the die", b"t"]
    got = langid.code_lengths(model, data)
    for i, d in enumerate(data):
        for li, lang in enumerate(model.langs):
            assert got[i, li] == pytest.approx(plain_bits(TEXTS[lang], d, contexts), rel=1e-4)


def test_probabilities_sum_to_one():
    model = langid.fit(TEXTS)
    per_class = np.bincount(model.classes, minlength=model.n_classes - 1)
    bits = model.bits.reshape(-1, model.n_classes, len(model.langs))[:, :-1]
    total = (np.exp2(-bits.astype(float)) * per_class[None, :, None]).sum(axis=1)
    assert np.allclose(total, 1.0, atol=1e-4)


def test_slices_and_blocks_do_not_change_lengths(monkeypatch):
    model = langid.fit(TEXTS)
    data = [b"the cat sat on the mat and the hund " * 40, b"katze", b""]
    want = langid.code_lengths(model, data)
    monkeypatch.setattr(langid, "SLICE", 7)
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert np.allclose(langid.code_lengths(model, data), want, rtol=1e-5)
    # a text longer than a block is scored in pieces that see the bytes before them
    long = [b"the cat sat on the mat " * 20_000]
    monkeypatch.setattr(langid, "SLICE", 512)
    parts = langid.code_lengths(model, long)
    monkeypatch.setattr(langid, "BLOCK", 8_000_000)
    assert np.allclose(langid.code_lengths(model, long), parts, rtol=1e-5)


def test_every_frequent_context_is_kept_with_many_languages():
    rng = np.random.default_rng(6)
    texts = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijkl"), 4000))] for k in range(30)}
    model = langid.fit(texts)
    contexts = known_contexts(model, texts)
    assert len(contexts) > 15_000 and len(model.bits) == len(contexts) * model.n_classes
    data = b"abcdefghijkl" * 5
    got = langid.code_lengths(model, [data])[0]
    for li in (0, 29):
        assert got[li] == pytest.approx(plain_bits(texts[model.langs[li]], data, contexts), rel=1e-4)


def test_edge_texts(spark):
    model = langid.fit(TEXTS)
    got = langid.detect(model, [None, "", "123 !?", "the", "İß ü"])
    assert got["lang_pred"].tolist()[:3] == ["und"] * 3 and got["lang_pred"].tolist()[3] == "a"
    assert got["lang_pred"].tolist()[4] in ("a", "b") and got["score"].between(0, 1).all()
    assert langid.detect(langid.fit({}), ["abc", None])["lang_pred"].tolist() == ["und", "und"]
    rows = spark.createDataFrame([(1, None, "a"), (2, "x", None), (None, "the cat", "a")],
                                 "doc_id long, text string, lang string")
    assert langid.training_sample(rows) == {"a": ["the cat"]}
    assert langid.training_sample(rows.limit(0)) == {}


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF001).join(
        spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
