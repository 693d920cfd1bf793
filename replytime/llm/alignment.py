r"""Cross-tokenizer alignment of token ids with whitespace-token anchors.

Every text is encoded whole by two tokenizers, a byte-level BPE (A, of space + text)
and a piece model (B, which puts the space itself).  Where both have made the same
bytes, byte offsets at which a token of A and a token of B both end cut the tokens
into groups; a link is a pair of token occurrences whose byte ranges overlap.

Method.  Shared ends before tokens that both begin with
a space are anchors (shared in byte offsets, verified against the joined bytes
of both token sequences).  Anchors split a document into windows of token ids,
and a window's alignment depends on its ids alone, so it is memoised by the two
id tuples (packed as 32-bit numbers).  Where the tokenizers are known to cut before the blanks between words
(`Aligner.divides`), words have ids of their own, wherever they
stand: a text's words are looked up in a memo, and those it lacks are encoded together, cut at the anchors before them
and aligned as windows.  Other texts are encoded whole.  A document's links go to Spark as (id pair, times); the corpus-wide
counts of id pairs are one aggregate, and each document's links are joined back
to them.

Edge cases: a text that is null, empty, or whose tokens do not give back
space + text byte for byte has no tokens: counts 0 and an empty ``groups_sha256``.
Ids of documents are not used, so null or repeated ids and repeated rows are
aligned and counted each on their own.  Texts of any length are handled whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, tidy

#: Words or windows in a memo at most, about (400 bytes each); a full memo is emptied (results do not change), as is any
#: at the end of a task.
MEMO_WINDOWS = 150_000
#: Windows of more tokens are not memoised.
MEMO_TOKENS = 32
#: Texts without a code point beyond these are cut into words alike by all versions of the Unicode tables.
SETTLED = re.compile("[^\x00-\u024f]")
#: A blank and all that follows up to the next blank that does not follow white space; white space at the end of the text
#: stays with the last word.  Python's white space has all of Unicode's.
WORD = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?| \s+\Z")
#: Unknown words that are encoded as one text (the piece model's time for a word grows with the text).
TEXT_WORDS = 100
#: Code points that are encoded in one call, about; a longer text is a call of its own.
CALL_CHARS = 500_000
#: A table of more id pairs than this (24 bytes each) is joined by a shuffle instead of being sent to all executors.
SMALL_PAIRS = 2_000_000
#: Stands between the ids of A and of B in a packed window; no id is as large.
BORDER = 2 ** 32 - 1
SPACE_MARK = "▁"

SCHEMA = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<int>, groups string")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merge_ranks(vocabulary: dict, of: dict[str, int]) -> tuple[str, dict[bytes, int]] | None:
    """Pattern and ranks of a byte-level BPE file whose ids ascend with its merges, else None."""
    from public_tokenizers import PATTERN

    model, special = vocabulary["model"], {t["content"] for t in vocabulary["added_tokens"]}
    plain = vocabulary["normalizer"] is None and vocabulary["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(p)] for p in pairs]
    if not plain or model["dropout"] or model["ignore_merges"] or ids != sorted(set(ids)):
        return None
    return PATTERN, {bytes([of[c] for c in entry]): k for entry, k in model["vocab"].items() if entry not in special}


def _pieces_divide(b_model: bytes) -> bool:
    """Whether a piece model surely cuts before every blank that follows another character.

    So it does if it merges pairs of pieces, takes the text as it is, and has no piece with a space mark behind
    another character: no merge joins across such a place, and merges on its two sides do not depend on each other.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(b_model)
    trained, normal, kind = model.trainer_spec, model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    return (trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
            and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
            and not normal.precompiled_charsmap
            and all(p.type in (kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE) for p in model.pieces)
            and not any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in model.pieces))


class Aligner:
    """Both tokenizers, the bytes of their tokens and the memo of windows.

    Where a text has only characters that every version of the Unicode tables classes alike, A's ids come from
    the same vocabulary and merges run as ranks, which is several times faster and gives the same ids.

    `divides` says that ids can be made word by word, if a word begins with a blank that follows another character
    than a blank, and has no white space before or no white space behind it.  B's part is told by `_pieces_divide`.
    A's pattern has white space only at the beginning of a match or in a match of nothing else; of white space before
    another character it leaves the last one to the next match.  So a match ends before such a blank, and as the
    pattern looks ahead only from white space for more of it, the matches on one side do not depend on the other.
    """

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        of = byte_alphabet()
        ranks = _merge_ranks(json.loads(a_json), of)
        self.fast = ranks and tiktoken.Encoding("a", pat_str=ranks[0], mergeable_ranks=ranks[1], special_tokens={})
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes([of[c] for c in entry]) if all(c in of for c in entry) else entry.encode("utf-8")
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else
                                piece.replace(SPACE_MARK, " ").encode("utf-8"))
        self.n_b = len(self.b_bytes)
        self._a_size = np.array([len(x) for x in self.a_bytes])
        self._b_size = np.array([len(x) for x in self.b_bytes])
        self._a_space = np.array([x[:1] == b" " for x in self.a_bytes])
        self._b_space = np.array([x[:1] == b" " for x in self.b_bytes])
        # written ids with what stands before them: inside a group, before a group, between A and B, before a window
        self._names = [mark + str(k) for mark in ",;|\n" for k in range(max(len(self.a_bytes), self.n_b))]
        self._windows: dict[bytes, tuple[bytes, int, bytes, int, int]] = {}
        self.divides = self.fast is not None and _pieces_divide(b_model)
        self._words: dict[str, tuple[bytes, int, bytes, int, int]] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[int]]]:
        """Ids of A and B of each text."""
        b = self.b.encode(texts, num_threads=1)
        a: list = [None if self.fast is None or SETTLED.search(t) else
                   self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        rest = [k for k, ids in enumerate(a) if ids is None]
        for k, made in zip(rest, self.a.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False)):
            a[k] = np.array(made.ids, dtype=np.uint32)
        return list(zip(a, b))

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of A and of B at which windows begin, the ends of both last."""
        a_start = np.cumsum(self._a_size[a]) - self._a_size[a]
        b_start = np.cumsum(self._b_size[b]) - self._b_size[b]
        a_marked, b_marked = np.flatnonzero(self._a_space[a]), np.flatnonzero(self._b_space[b])
        a_at, b_at = a_start[a_marked], b_start[b_marked]  # both ascend
        k = np.searchsorted(b_at, a_at)
        shared = k < len(b_at)
        shared[shared] = b_at[k[shared]] == a_at[shared]
        i, k = a_marked[shared], b_marked[k[shared]]
        first = [] if len(i) and not i[0] and not k[0] else [0]  # the document begins a window
        return np.concatenate([first, i, [len(a)]]).astype(np.int64), np.concatenate([first, k, [len(b)]]).astype(np.int64)

    def _keys(self, text: str, a: np.ndarray, b: list[int], starts: np.ndarray | None = None) -> list[bytes] | None:
        """The windows of a text as packed id tuples (ids of A, a border, ids of B).

        None if the tokens do not give back space + text.  A's tokens are byte strings cut from it in order, so it
        is enough that their sizes add up.  Windows begin at all anchors, or only at those at the byte offsets
        `starts`; None if one of these is no anchor.
        """
        whole = b" " + text.encode("utf-8")
        of_b = self.b_bytes
        if b"".join([of_b[x] for x in b]) != whole or int(self._a_size[a].sum()) != len(whole):
            return None
        b = np.array(b, dtype=np.uint32)
        at_a, at_b = self.anchors(a, b)
        if starts is not None:
            offsets = np.cumsum(self._a_size[a])[at_a[1:] - 1]  # where the windows end
            offsets = np.concatenate([[0], offsets])
            keep = np.searchsorted(offsets, starts)
            if not np.array_equal(offsets[keep], starts):
                return None
            keep = np.append(keep, len(at_a) - 1)
            at_a, at_b = at_a[keep], at_b[keep]
        window = np.arange(len(at_a) - 1)
        packed = np.full(len(a) + len(b) + len(window), BORDER, dtype=np.uint32)
        packed[np.arange(len(a)) + np.repeat(at_b[:-1] + window, np.diff(at_a))] = a
        packed[np.arange(len(b)) + np.repeat(at_a[1:] + window + 1, np.diff(at_b))] = b
        raw = packed.tobytes()
        at = (4 * (at_a + at_b + np.arange(len(at_a)))).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def _learn(self, keys: list[bytes]) -> list[tuple[bytes, int, bytes, int, int]]:
        """Aligns windows, all at once; for each: groups as text, their number, packed codes of the links, ids of A, of B.

        The windows are laid end to end.  Every end of a token closes one link; every shared end closes a group,
        whose tokens of A are written before those of B.  A link's code is A id times B's size, plus B id.
        """
        packed = np.frombuffer(b"".join(keys), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(k) // 4 for k in keys])
        starts = np.concatenate([[0], ends[:-1]])
        border = np.flatnonzero(packed == BORDER)
        in_a = np.repeat(np.tile([True, False], len(keys)), np.diff(np.stack([border, ends], axis=1).ravel(), prepend=0))
        a = packed[in_a & (packed != BORDER)]
        b = packed[~in_a & (packed != BORDER)]
        last_a = np.cumsum(border - starts) - 1  # last token of each window
        ends_a, ends_b = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        meets = np.searchsorted(ends_b, ends_a)
        shared_a = ends_b[meets] == ends_a
        shared_b = np.zeros(len(b), dtype=bool)
        shared_b[meets[shared_a]] = True

        at = np.sort(np.concatenate([ends_a, ends_b[~shared_b]]))
        codes = a[np.searchsorted(ends_a, at)] * self.n_b + b[np.searchsorted(ends_b, at)]
        to = np.searchsorted(at, ends_a[last_a], side="right").tolist()
        raw = codes.tobytes()

        closed = np.cumsum(shared_a)
        group_a, group_b = closed - shared_a, np.cumsum(shared_b) - shared_b
        upto_a, upto_b = np.flatnonzero(shared_a) + 1, np.concatenate([[0], np.flatnonzero(shared_b) + 1])
        first_a, first_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
        first_a[1:], first_b[1:] = shared_a[:-1], shared_b[:-1]
        mark_a, mark_b = np.where(first_a, 1, 0), np.where(first_b, 2, 0)
        mark_a[0] = 3
        mark_a[last_a[:-1] + 1] = 3
        written = np.empty(len(a) + len(b), dtype=np.int64)
        n = len(self._names) // 4
        written[np.arange(len(a)) + upto_b[group_a]] = mark_a * n + a
        written[np.arange(len(b)) + upto_a[group_b]] = mark_b * n + b
        names = self._names
        texts = "".join([names[k] for k in written.tolist()]).encode("ascii")[1:].split(b"\n")
        many = np.diff(closed[last_a], prepend=0).tolist()
        n_a, n_b = border - starts, ends - border - 1
        return list(zip(texts, many, [raw[8 * i:8 * j] for i, j in zip([0, *to], to)], n_a.tolist(), n_b.tolist()))

    def _learn_words(self, words: list[str]) -> bool:
        """Encodes and aligns distinct words and puts them into the memo; False if an expected anchor is missing.

        Words with white space behind their blank or at their end are encoded by themselves, the others together.
        """
        settled, others, alone = [], [], []
        for w in words:
            if w[0] == " " and w[1].isspace() or w[-1].isspace():
                alone.append(w)
            elif SETTLED.search(w):
                others.append(w)
            else:
                settled.append(w)
        words = settled + others + alone
        spaced = [w if w[0] == " " else " " + w for w in words]
        cuts = [*range(0, len(settled), TEXT_WORDS), *range(len(settled), len(settled) + len(others), TEXT_WORDS),
                *range(len(settled) + len(others), len(words)), len(words)]
        coded = self.encode(["".join(spaced[i:j])[1:] for i, j in zip(cuts, cuts[1:])])
        a, b = np.concatenate([x for x, _ in coded]), [k for _, ids in coded for k in ids]
        sizes = np.array([len(w) if w.isascii() else len(w.encode("utf-8")) for w in spaced])
        keys = self._keys("".join(spaced)[1:], a, b, np.cumsum(sizes) - sizes)
        if keys is None:
            return False
        self._words.update(zip(words, self._learn(keys)))
        return True

    def _look_up(self, text: str) -> tuple[list[str], list] | None:
        """The words of a text, and for each what the memo has.

        Words are split at blanks and stand without theirs.  A text with a blank before other white space, another
        blank or its end is cut with care instead; its words keep their blanks, so that the two kinds do not meet in
        the memo.  None if the text has a space mark, which the piece model takes for a blank.
        """
        if SPACE_MARK in text:
            return None
        words = text.split(" ")
        have = list(map(self._words.get, words))
        if any([v is None and (not w or w[0].isspace()) for w, v in zip(words, have)]):
            words = WORD.findall(" " + text)
            have = list(map(self._words.get, words))
        return words, have

    def documents(self, texts: list[str], groups: bool = False) -> list[tuple]:
        """The columns of SCHEMA for each text."""
        if not self.divides:
            return self._whole(texts, groups)
        known = self._words
        if len(known) > MEMO_WINDOWS:
            known.clear()
        found = [self._look_up(t) for t in texts]
        unknown = dict.fromkeys([w for f in found if f for w, v in zip(*f) if v is None])
        if unknown and not self._learn_words(list(unknown)):
            return self._whole(texts, groups)
        rest = iter(self._whole([t for t, f in zip(texts, found) if f is None], groups))
        rows = [next(rest) if f is None else self._row([v or known[w] for w, v in zip(*f)], groups) for f in found]
        for w in unknown:
            if known[w][3] + known[w][4] >= MEMO_TOKENS:
                del known[w]
        return rows

    def _whole(self, texts: list[str], groups: bool) -> list[tuple]:
        """The columns of SCHEMA for each text, encoded whole."""
        if len(self._windows) > MEMO_WINDOWS:
            self._windows.clear()
        coded = self.encode(texts)
        cut = [self._keys(text, a, b) for text, (a, b) in zip(texts, coded)]
        known = self._windows
        found = [keys and list(map(known.get, keys)) for keys in cut]
        unknown = dict.fromkeys([k for keys, have in zip(cut, found) if keys for k, v in zip(keys, have) if v is None])
        if unknown:
            known.update(zip(unknown, self._learn(list(unknown))))
        rows = [NONE if keys is None else self._row([v or known[k] for k, v in zip(keys, have)], groups)
                for keys, have in zip(cut, found)]
        for key in unknown:
            if len(key) > 4 * MEMO_TOKENS:
                del known[key]
        return rows

    def _row(self, made: list[tuple[bytes, int, bytes, int, int]], groups: bool) -> tuple:
        texts, many, links, n_a, n_b = zip(*made)
        written = b";".join(texts)
        links = np.frombuffer(b"".join(links), dtype=np.int64)
        pairs, times = np.unique(links, return_counts=True)
        return (sum(n_a), sum(n_b), sum(many), len(links), hashlib.sha256(written).hexdigest(),
                pairs, times.astype(np.int32), written.decode() if groups else None)

    def forget(self) -> None:
        """Empty the memos."""
        self._windows.clear()
        self._words.clear()


NONE = (0, 0, 0, 0, "", np.array([], dtype=np.int64), np.array([], dtype=np.int32), None)

_BUILT: dict[int, Aligner] = {}


def shared_aligner(a_json: bytes, b_model: bytes) -> Aligner:
    """The worker's aligner for these files, built once."""
    key = hash((a_json, b_model))
    if key not in _BUILT:
        _BUILT[key] = Aligner(a_json, b_model)
    return _BUILT[key]


def calls(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that are encoded together: CALL_CHARS code points, or one longer text; none that is empty."""
    now, size = [], 0
    for k, text in enumerate(texts):
        if text:
            if now and size + len(text) > CALL_CHARS:
                yield now
                now, size = [], 0
            now.append(k)
            size += len(text)
    if now:
        yield now


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: bool = False) -> DataFrame:
    """The table with a struct column of SCHEMA for each whole text; `groups` asks for the groups as text too.

    The vocabulary files (about 2 MB) are read by the driver and sent with the tasks.
    """
    files = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = shared_aligner(*files.value)
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the memo is costly to walk
        try:
            for batch in batches:
                texts = batch.tolist()
                rows = [NONE] * len(texts)
                for together in calls(texts):
                    for k, row in zip(together, aligner.documents([texts[k] for k in together], groups)):
                        rows[k] = row
                yield pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=object if i > 3 else "int64")
                                    for i, name in enumerate(names)})
        finally:
            aligner.forget()
            if collects:
                gc.enable()

    @F.pandas_udf(SCHEMA)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    return docs.withColumn("aligned", aligned(F.col(text)))


def align(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",), groups: bool = False) -> DataFrame:
    """The columns keep of the documents with the counts of their alignment.

    Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (and the groups as text, if asked
    for).  n_best is the number of links whose id pair is the most frequent of its B id in the corpus, ties
    included; count_sum sums the corpus counts of the links' pairs.  A kept column of one of these
    names gives way to the operator's.
    """
    row = free_name(docs, "row")
    texts = docs.select(F.struct(*keep).alias(row), F.col("text").cast("string").alias("text"))
    base = stored(encoded(texts.withColumn("rid", F.monotonically_increasing_id()), a_path, b_path, groups=groups)
                  .select(row, "rid", "aligned.*"))
    links = base.select("rid", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = stored(links.groupBy("pair").agg(F.sum("times").alias("count")))
    b = F.col("pair") % b_size(b_path)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    judged = stored(counts.withColumn("b", b).join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")))
    # id pairs are bounded by the vocabularies, but that bound is too large to be sent: their number decides
    few = judged.count() <= SMALL_PAIRS
    sums = links.join(F.broadcast(judged) if few else judged, "pair").groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    whole = base.drop("pairs", "times").join(sums, "rid", "left").fillna(0, ["n_best", "count_sum"])
    return whole.select(*[F.col(f"{row}.{c}") for c in keep if c.lower() not in made], *made)


def b_size(b_path: str) -> int:
    """Number of pieces of B."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
