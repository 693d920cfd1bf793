"""Language identification by prediction by partial matching.

Method: for each language a variable-order tree of byte contexts (up to
``ORDER`` bytes, lower-cased text) holds symbol counts.  The probability of a
byte is its count in the longest context, with an escape probability
(distinct / (total + distinct)) to the next shorter context, whose already
seen symbols are excluded; below the empty context all 256 bytes are equally
likely.  The statistics are frozen after training, so the code length of a
text is the exact sum of -log2 p over all its bytes.  The language with the
shortest code wins.

Because statistics are frozen, all trees together form one deterministic
automaton: state = longest known context.  A context stores only the symbols
seen in it (next state, code lengths in all languages) and the escapes on the
way to the empty context; a table of one number for each state and symbol
names the entry of the longest context that has the symbol.  Texts are scored by
walking that table over many equal slices of the text at once; a slice
starts ``ORDER`` bytes early, which fixes its state exactly.

Training takes at most ``docs_per_lang`` labelled documents a language, of at
most ``max_chars`` code points each, chosen by a hash of the id; that sample
alone bounds the model, which keeps every context seen ``MIN_COUNT`` times.
Every document is scored whole.

Edge cases: a null text or one without a letter is ``und`` with score 0; with
no training rows everything is ``und``.  Ties go to the language that is
first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_by_hash, tidy

UNKNOWN = "und"
ORDER = 4
#: Contexts seen less often in all languages together are left out.
MIN_COUNT = 4
SLICE = 512
#: Code lengths held at a time (bytes of text times languages).
BLOCK = 2_000_000
SCHEMA = "lang_pred string, score double, bits_per_byte double"


@dataclass
class PpmModel:
    """Frozen statistics: languages, byte classes, entries of the seen symbols and escapes, in bits."""
    langs: list[str]
    classes: np.ndarray     # 256 -> class; the last class resets to the empty context
    slot: np.ndarray        # state * n_classes + class -> entry of the longest context with the symbol
    follow: np.ndarray      # entry -> state
    cost: np.ndarray        # entry -> code length by language, less the escapes of the entry's context
    escape: np.ndarray      # state -> escapes down to the empty context by language

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 2

    @property
    def bits(self) -> np.ndarray:
        """Code lengths of every state * n_classes + class (the whole table: for tests)."""
        return self.cost[self.slot] + np.repeat(self.escape, self.n_classes, axis=0)


def _normal(text: str) -> bytes:
    return text.lower().encode("utf-8")


def fit(texts_by_lang: dict[str, list[str]], order: int = ORDER) -> PpmModel:
    """Count contexts and freeze the tables."""
    langs = sorted(texts_by_lang)
    raw = {lang: [np.frombuffer(_normal(t), np.uint8) for t in texts_by_lang[lang]] for lang in langs}
    used = np.zeros(256, bool)
    for parts in raw.values():
        for p in parts:
            used[p] = True
    # byte classes: every byte seen has its own; those never seen share one
    classes = np.full(256, int(used.sum()), np.int64)
    classes[used] = np.arange(int(used.sum()))
    width = int(used.sum()) + 1
    reset = width  # one more class: back to the empty context
    columns = width + 1

    # counts of (context of k classes, symbol) by language; windows never span two texts
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for k in range(order + 1):
        row = []
        for lang in langs:
            codes = []
            for p in raw[lang]:
                c = classes[p]
                if len(c) > k:
                    code = np.zeros(len(c) - k, np.int64)
                    for j in range(k + 1):
                        code = code * width + c[j:len(c) - k + j]
                    codes.append(code)
            row.append(np.unique(np.concatenate(codes), return_counts=True) if codes
                       else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        grams.append(row)

    # contexts: closed under dropping the first or the last byte; states number them by order and code
    known: list[np.ndarray] = [np.zeros(1, np.int64)]
    for k in range(1, order + 1):
        ctx, at = np.unique(np.concatenate([codes // width for codes, _ in grams[k]] or [known[0][:0]]),
                            return_inverse=True)
        tally = np.bincount(at, weights=np.concatenate([n for _, n in grams[k]] or [known[0][:0]]), minlength=len(ctx))
        known.append(ctx[(tally >= MIN_COUNT) & np.isin(ctx // width, known[k - 1])
                         & np.isin(ctx % width ** (k - 1), known[k - 1])])
    first = np.cumsum([0, *map(len, known)])

    # each order refines the row of the context that is one byte shorter; entry 0 is the reset
    slot = np.zeros((first[-1], columns), np.int32)
    slot[0, :width] = np.arange(1, columns)
    escape = np.zeros((first[-1], len(langs)))
    cost = np.full((columns, len(langs)), 8.0)
    cost[0] = 0.0
    follow = np.zeros(columns, np.int32)
    for k in range(order + 1):
        if k:
            own = np.arange(first[k], first[k + 1])
            shorter = first[k - 1] + np.searchsorted(known[k - 1], known[k] % width ** (k - 1))
            slot[own] = slot[shorter]
            escape[own] = escape[shorter]
        seen = [(codes[ok], n[ok]) for codes, n in grams[k] for ok in [np.isin(codes // width, known[k])]]
        pairs = np.unique(np.concatenate([codes for codes, _ in seen] or [known[0][:0]]))
        state, symbol = first[k] + np.searchsorted(known[k], pairs // width), pairs % width
        before = slot[state, symbol]
        fresh, to = cost[before], follow[before]
        for li, (codes, n) in enumerate(seen):
            at = np.searchsorted(pairs, codes)
            s = state[at]
            base = np.exp2(-(cost[before[at], li] + escape[s, li]))
            total, distinct, rest = (np.bincount(s, weights=w, minlength=len(slot)) for w in (n, np.ones(len(n)), base))
            here = np.flatnonzero(distinct)
            escape[here, li] += np.log2((total[here] + distinct[here]) / distinct[here] * np.maximum(1e-9, 1 - rest[here]))
            fresh[at, li] = -np.log2(n / (total[s] + distinct[s])) - escape[s, li]
        if k < order:  # a longer known context where there is one
            to[np.searchsorted(pairs, known[k + 1])] = np.arange(first[k + 1], first[k + 2])
        slot[state, symbol] = np.arange(len(cost), len(cost) + len(pairs))
        cost, follow = np.concatenate([cost, fresh]), np.concatenate([follow, to])
    return PpmModel(langs, classes, slot.reshape(-1), follow, cost.astype(np.float32), escape.astype(np.float32))


def code_lengths(model: PpmModel, texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Bits of each whole text in each language."""
    out = np.zeros((len(texts), len(model.langs)))
    columns = model.n_classes
    reset = columns - 1
    block = max(100_000, BLOCK // max(1, len(model.langs)))
    gap = np.full(order, reset, np.int32)
    parts, owners, size = [], [], 0

    def flush() -> None:
        nonlocal parts, owners, size
        if not parts:
            return
        flat = np.concatenate(parts)
        n = len(flat)
        rows = -(-n // SLICE)
        grid = np.full(rows * SLICE + order, reset, np.int32)
        grid[order:order + n] = flat
        state = np.zeros(rows, np.int64)
        base = np.arange(rows) * SLICE
        cost = np.zeros((rows, SLICE, len(model.langs)), np.float32)
        for step in range(order + SLICE):
            entry = model.slot[state * columns + grid[base + step]]
            if step >= order:
                cost[:, step - order] = model.cost[entry] + model.escape[state]
            state = model.follow[entry].astype(np.int64)
        cost = cost.reshape(-1, len(model.langs))
        for owner, a, b in owners:
            out[owner] += cost[a:b].sum(axis=0, dtype=np.float64)
        parts, owners, size = [], [], 0

    for i, text in enumerate(texts):
        symbols = model.classes[np.frombuffer(text, np.uint8)].astype(np.int32)
        for a in range(0, len(symbols), block):
            piece = symbols[a:a + block]
            lead = symbols[max(0, a - order):a]  # the bytes before fix the state; they are not counted again
            parts += [gap, lead, piece]
            begin = size + order + len(lead)
            owners.append((i, begin, begin + len(piece)))
            size = begin + len(piece)
            if size >= block:
                flush()
    flush()
    return out


def detect(model: PpmModel, texts: list[str | None]) -> pd.DataFrame:
    """Language, posterior probability (equal priors) and bits a byte of each text."""
    raw = [_normal(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
    if not model.langs:
        raw = [b""] * len(raw)
    lengths = code_lengths(model, raw) if model.langs else np.zeros((len(raw), 1))
    best = lengths.argmin(axis=1)
    shortest = lengths.min(axis=1)
    with np.errstate(under="ignore"):
        score = 1.0 / np.exp2(np.minimum(0.0, shortest[:, None] - lengths)).sum(axis=1)
    known = np.array([bool(r) for r in raw], bool)
    size = np.array([max(1, len(r)) for r in raw])
    return pd.DataFrame({
        "lang_pred": [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)],
        "score": np.where(known, np.clip(score, 0.0, 1.0), 0.0),
        "bits_per_byte": np.where(known, shortest / size, np.nan),
    })


def training_sample(labelled: DataFrame, docs_per_lang: int = 100, max_chars: int = 20_000) -> dict[str, list[str]]:
    """Texts by language: at most docs_per_lang each, by a hash of the id."""
    rows = labelled.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    h = F.xxhash64(F.col("doc_id"), F.lit(17))
    out: dict[str, list[str]] = {}
    picked = sample_by_hash(rows, h, docs_per_lang, F.col("lang")).select("lang", "text", h.alias("h"))
    # the number taken varies a little: what exceeds it is left before anything is collected
    w = Window.partitionBy("lang").orderBy("h", "text")
    picked = picked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs_per_lang)
    for r in picked.select("lang", "text").orderBy("lang", "h", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def train(labelled: DataFrame, docs_per_lang: int = 100, max_chars: int = 20_000) -> PpmModel:
    """Model from the columns doc_id, text and lang of the given rows."""
    return fit(training_sample(labelled, docs_per_lang, max_chars))


def detector(docs: DataFrame, model: PpmModel):
    """Column function: text -> struct(lang_pred, score, bits_per_byte)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield detect(shipped.value, texts.tolist())

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    def apply(text: Column) -> Column:
        return predict(text)

    return apply
