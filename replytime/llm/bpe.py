"""Byte-level BPE encoding and decoding.

Method: token byte strings are mapped to Latin-1 text (one character per
byte) and put in one Aho-Corasick automaton.  A piece is scanned once; the
automaton reports every token that ends at each position.  From the start
of the piece the longest token is taken whose pair with the token before it
is compatible, and when no token fits, the last token is given back and a
shorter one tried.  A position that cannot be continued is marked, so it is
visited once.  Two adjacent tokens are compatible when merging their joined
bytes by rank yields exactly these two tokens (checked backwards, by taking
both apart at their border); the answer is memoised.  A
token sequence is the merge result if and only if all adjacent pairs are
compatible, so the ids equal rank-ordered merging in time linear in the piece.

Edge cases: a null or empty text has no ids and decodes to empty bytes.
Texts of any length are handled whole; only one piece is held as match lists.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, tidy

#: Entries of the piece memo and of the pair memo at most; a full memo is emptied (results do not change), and both
#: are emptied at the end of a task, so that a worker does not hold them while it does other work.
MEMO_PIECES = 150_000
MEMO_PAIRS = 200_000
#: Longer pieces are not memoised.
MEMO_BYTES = 64


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the token, blank, rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class ByteBpe:
    """Encoder and decoder for one vocabulary and one piece pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._size = [0] * (max(ranks.values(), default=-1) + 1)
        self._shorter = [-1] * len(self._size)
        self.memo = 1.0  # share of MEMO_PIECES and MEMO_PAIRS that is used
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._automaton = ahocorasick.Automaton()
        # the two parts of which merging builds a token; None for single bytes
        self._parts: list[tuple[int, int] | None] = [None] * len(self._size)
        # a token that merging does not build is only ever a whole piece
        built = set()
        for token, rank in ranks.items():
            parts, last = self._merge(token)
            if parts == [token]:
                built.add(token)
                self._parts[rank] = last and (ranks[last[0]], ranks[last[1]])
        for token in built:
            rank = ranks[token]
            self._size[rank] = len(token)
            for k in range(len(token) - 1, 0, -1):  # the longest token that begins this one
                if token[:k] in built:
                    self._shorter[rank] = ranks[token[:k]]
                    break
            self._automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self._automaton.make_automaton()
        # every token is younger than its parts (so in any trained vocabulary): pairs can be checked backwards
        self._ordered = all(x < r or self._parts[x] is None for r, p in enumerate(self._parts) if p for x in p)

    def _merge(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Rank-ordered merging of a short byte string, and the pair that was merged when two parts were left."""
        ranks = self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            if len(parts) == 2:
                last = parts[0], parts[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _meets(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens joins anything across their border.

        The tokens are taken apart at the border, the youngest merge first.
        Until the merge of rank `limit` took place, the parts at the border
        lay side by side; they were merged if their own rank is below it (of
        equal ranks the left merge comes first).
        """
        of, ranks, parts = self.bytes_of, self.ranks, self._parts
        limit = len(self._size)
        while True:
            rank = ranks.get(of[left] + of[right])
            if rank is not None and rank < limit:
                return True
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return False
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _compatible(self, left: int, right: int) -> bool:
        key = left * len(self._size) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.memo * MEMO_PAIRS:
                self._pairs.clear()
            if self._ordered:
                known = not self._meets(left, right)
            else:
                known = self._merge(self.bytes_of[left] + self.bytes_of[right])[0] == [
                    self.bytes_of[left], self.bytes_of[right]]
            self._pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (reach, rank) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - reach] = rank  # ends ascend: the last one reported for a start is the longest
        size, shorter, compatible = self._size, self._shorter, self._compatible
        alive = bytearray(b"\x01" * (n + 1))
        ids: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            while token >= 0:
                if alive[pos + size[token]] and (not ids or compatible(ids[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                pos += size[token]
                token = longest[pos]
            elif ids:
                alive[pos] = 0
                last = ids.pop()
                pos -= size[last]
                token = shorter[last]
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text: each match of the pattern on its own."""
        ids: list[int] = []
        pieces = self._pieces
        for piece in self.pattern.findall(text):
            known = pieces.get(piece)
            if known is None:
                raw = piece.encode("utf-8")
                known = tuple(self.encode_piece(raw))
                if len(raw) <= MEMO_BYTES:
                    if len(pieces) >= self.memo * MEMO_PIECES:
                        pieces.clear()
                    pieces[piece] = known
            ids.extend(known)
        return ids

    def forget(self) -> None:
        """Empty the memos."""
        self._pieces.clear()
        self._pairs.clear()

    def decode(self, ids) -> bytes:
        """Bytes of the tokens in order."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


_BUILT: dict[tuple[int, str], ByteBpe] = {}


def shared_bpe(vocabulary: bytes, pattern: str) -> ByteBpe:
    """The worker's encoder for this vocabulary, built once."""
    key = (hash(vocabulary), pattern)
    if key not in _BUILT:
        _BUILT[key] = ByteBpe(read_ranks(vocabulary), pattern)
    return _BUILT[key]


def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file, read by the driver and sent with the tasks (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def codec(spark: SparkSession, path: str, pattern: str):
    """Column functions ``(encode, decode)``: text -> array<int>, array<int> -> binary."""
    vocabulary = spark.sparkContext.broadcast(vocabulary_bytes(path))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = shared_bpe(vocabulary.value, pattern)
        return pd.Series([bpe.encode(t) if t else [] for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = shared_bpe(vocabulary.value, pattern)
        return pd.Series([bpe.decode(x if isinstance(x, list) else x.tolist()) if x is not None else b"" for x in ids], dtype=object)

    return encode, decode


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text",
                     ids: str = "token_ids", decoded: str = "decoded", memo: float = 1.0) -> DataFrame:
    """The table with the ids of each whole text and the bytes that these ids decode to.

    `memo` is the share of the memos' full size: less memory in a worker for more time, the ids do not change.
    Both come from one call a batch; calling the two column functions one on
    the other would encode twice.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = shared_bpe(vocabulary.value, pattern)
        bpe.memo = memo
        try:
            for texts in batches:
                coded = [bpe.encode(t) if t else [] for t in texts]
                yield pd.DataFrame({"ids": pd.Series(coded, dtype=object),
                                    "decoded": pd.Series([bpe.decode(x) for x in coded], dtype=object)})
        finally:
            bpe.forget()

    @F.pandas_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    pair = free_name(docs, "coded")
    return (docs.withColumn(pair, both(F.col(text)))
            .withColumn(ids, F.col(f"{pair}.ids")).withColumn(decoded, F.col(f"{pair}.decoded")).drop(pair))


def digests(ids: Column, decoded: Column) -> list[Column]:
    """Number of ids, hash of the decimal ids joined by one blank, hash of the decoded bytes."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]
