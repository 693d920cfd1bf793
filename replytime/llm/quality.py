"""Quality rules from compression bands.

Method: a text's UTF-8 bytes are compressed with zstandard as a whole and in
fixed chunks.  Ratios (compressed / raw bytes) below a lower limit mean
repetitive text, above an upper limit incompressible text; the limits depend
on the length, because short texts compress less.  A text of which even the least
compressible chunk lies below a limit is repetitive throughout.  Against the lower limits
the compressed bytes are counted per code point, because scripts of two or
three bytes a code point compress more per byte than Latin ones.

Base counts over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: code points in
words, symbols ``[#*$%&|<>]``, lines (split at ``\\n``, with a word) equal to an
earlier line, and words lying in a 3-word window found twice or more.

Edge cases: a null text counts as empty; an empty text has no words and is
rejected by the base rule.  Every row is judged on its own, so repeated rows
get equal answers, and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WORD, tidy

LEVEL = 3
CHUNK = 1024
#: (bytes below, least and most ratio of the whole, least ratio of the highest chunk); the last holds for all longer
#: texts.  The lower limits of the whole lie under real English prose and documentation of that length: in 782 texts
#: (common-licenses, Python's help topics, /usr/share/doc) 95 % of the pieces of 1, 2, 4, 8, 16 and 32 KB are above 0.37,
#: 0.31, 0.27, 0.25, 0.23 and 0.22; the licenses of 4 KB or more lie between 0.33 and 0.42.  Real texts repeat themselves
#: over long distances or in tables, but some chunk of 1 KB is plain prose: their highest chunk is 0.498 at least from 2 KB
#: and 0.511 from 4 KB on.  Spam repeats itself in every chunk: a symbol group after each word gives 0.45 to 0.51 in all.
BANDS = [
    (256, 0.30, 1.20, 0.0), (512, 0.30, 0.95, 0.0), (1024, 0.30, 0.90, 0.0), (2048, 0.28, 0.85, 0.48),
    (4096, 0.25, 0.85, 0.49), (8192, 0.23, 0.80, 0.505), (16384, 0.22, 0.80, 0.505), (32768, 0.20, 0.80, 0.505),
    (None, 0.15, 0.80, 0.505),
]
#: Least and most ratio of the middle (median) full chunk; help topics full of tables come down to 0.216.
CHUNK_BAND = (0.21, 0.75)
SYMBOLS = "#*$%&|<>"

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_bytes long, whole_ratio double, chunk_ratio double, top_chunk_ratio double")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    first: dict[tuple[str, str, str], int] = {}
    repeated: set[tuple[str, str, str]] = set()
    for w in zip(words, words[1:], words[2:]):
        if w in first:
            repeated.add(w)
        else:
            first[w] = 1
    covered = 0
    if repeated:
        end = 0  # words before this one are counted already
        for k, w in enumerate(zip(words, words[1:], words[2:])):
            if w in repeated:
                covered += k + 3 - max(end, k)
                end = k + 3
    return n, sum(map(len, words)), sum(text.count(s) for s in SYMBOLS), dup, covered


def chunk_ratios(raw: bytes, pack: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the full chunks, ascending."""
    return sorted(len(pack.compress(raw[k:k + CHUNK])) / CHUNK for k in range(0, len(raw) - CHUNK + 1, CHUNK))


def ratios(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float | None, float | None]:
    """Ratio of the whole, and the median ratio of the full chunks (None if there are none)."""
    if not raw:
        return None, None
    parts = chunk_ratios(raw, pack)
    return len(pack.compress(raw)) / len(raw), parts[len(parts) // 2] if parts else None


def in_band(n_bytes: int, whole: float | None, chunk: float | None, width: float = 1.0, top: float | None = None) -> bool:
    """Whether the ratios lie inside the limits for this length.

    chunk and top are the median and the highest ratio of the chunks, width the text's bytes per code point.
    """
    if whole is None:
        return False
    _, low, high, top_low = next(b for b in BANDS if b[0] is None or n_bytes < b[0])
    near = chunk is None or CHUNK_BAND[0] <= chunk * width and chunk <= CHUNK_BAND[1]
    return low <= whole * width and whole <= high and near and (top is None or top_low <= top * width)


def judge(text: str | None, pack: zstandard.ZstdCompressor) -> tuple:
    """All columns of SCHEMA for one text."""
    text = text or ""
    n, chars, symbols, dup, repeat = base_counts(text)
    raw = text.encode("utf-8")
    parts = chunk_ratios(raw, pack)
    whole = len(pack.compress(raw)) / len(raw) if raw else None
    chunk, top = (parts[len(parts) // 2], parts[-1]) if parts else (None, None)
    failed = n < 50 or 100 * repeat > 50 * n
    inside = in_band(len(raw), whole, chunk, len(raw) / max(1, len(text)), top)
    return n, chars, symbols, dup, repeat, failed, not failed and inside, len(raw), whole, chunk, top


def quality(text: Column) -> Column:
    """Struct of the counts, ratios and verdict (SCHEMA) of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for texts in batches:
            out = pd.DataFrame([judge(t, pack) for t in texts], columns=names)
            yield out.astype({"whole_ratio": "float64", "chunk_ratio": "float64", "top_chunk_ratio": "float64"})

    @F.pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    return judged(text)
