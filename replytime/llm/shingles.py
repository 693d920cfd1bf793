"""Hashed word shingles of whole texts, computed for many texts at once.

A word's hash is a polynomial of its bytes (A-Z lower-cased) modulo 2**64,
taken from running sums over a block of text and mixed with its length; a
shingle's hash combines the hashes of its words.  Blocks are cut between
words, so memory does not grow with a text's length (only its words' hashes
are held).
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK = 1 << 19

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_LENGTH, _BASE, _SHORT = (int(x) * 2 + 1 for x in _RANDOM.integers(1, 1 << 62, 3))
_BASE = _BASE | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _block_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block and the places where they begin."""
    data = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    up, down = _powers(len(data))
    value = _BYTE[_LOWER[data]]
    value[space] = 0
    value *= up[:len(data)]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=run[1:])
    return mixed((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64) * _U(_LENGTH)), begin


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[bytes] = []
    owner: list[int] = []
    starts: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, starts, size
        if held:
            hashes, begin = _block_hashes(b" ".join(held))
            ends = np.searchsorted(begin, np.array([*starts[1:], size]))
            a = 0
            for i, b in zip(owner, ends.tolist()):
                out[i].append(hashes[a:b])
                a = b
        held, owner, starts, size = [], [], [], 0

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8")
        pos = 0
        while pos < len(raw):
            end = min(len(raw), pos + BLOCK)
            while end < len(raw) and not _IS_SPACE[raw[end]]:
                end += 1
            held.append(raw[pos:end])
            owner.append(i)
            starts.append(size)
            size += end - pos + 1
            pos = end
            if size >= BLOCK:
                flush()
    flush()
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in out]


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, ascending; fewer words than WORDS make one shingle."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        short = (words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
        return mixed(short + np.full(1, n * _SHORT % (1 << 64), np.uint64))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += words[k:n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text."""
    return [shingles_of(w) for w in word_hashes(texts)]


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    total = mixed(shingles * _U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True)
    key = int(mixed(total + np.full(1, len(shingles), np.uint64))[0])
    return key - (1 << 64) if key >= 1 << 63 else key
