r"""Chat formatting with offset-aligned loss masks.

Method: a conversation is rendered whole, encoded once (byte-level BPE, so
that token offsets are the running byte lengths), and the sorted spans of its
assistant texts are intersected with the token offsets by binary search.
A token that overlaps a span is under the mask; the part outside the span is
clipped when the masked text is read.

Template, one turn a line:
    [INST] text [/INST]          user
    <s>text</s>                  assistant (text under the loss mask)
    <<SYS>>text<</SYS>>          system
    <<ROLE:name>>text<</ROLE>>   any other role, its name percent-encoded
Control strings inside texts get one more backslash after their first
character (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which is
undone when reading back; so a rendered text never holds a control string.

Rows are dealt by conversation and sorted by turn; a conversation is never
collected: it is rendered turn by turn and written in blocks of at least
``block_chars`` (one block for all but giant conversations).  Blocks end at a
line end, where the piece pattern splits anyway, so the ids are those of the
whole conversation.

Edge cases: a null text is empty, a null role is the role with the empty
name; rows with a null conv_id form one conversation; rows with equal turn
are ordered by role, then text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_bpe, vocabulary_bytes

_ESCAPE = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]|SYS>>|ROLE>>|ROLE:))")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]|SYS>>|ROLE>>|ROLE:))")
_FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_OPEN = re.compile(r"\[INST\] |<s>|<<SYS>>|<<ROLE:([^>]*)>>")
_CLOSE = {"[INST] ": " [/INST]\n", "<s>": "</s>\n", "<<SYS>>": "<</SYS>>\n"}
_ROLE_OF = {"[INST] ": "user", "<s>": "assistant", "<<SYS>>": "system"}

FORMATTED = ("conv_id long, block int, formatted string, token_ids array<int>, loss_mask array<boolean>, "
             "spans array<struct<begin:long,end:long>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def frame(role: str | None) -> tuple[str, str]:
    """Strings before and after a text of this role."""
    if role in _FRAMES:
        return _FRAMES[role]
    return f"<<ROLE:{quote(role or '', safe='')}>>", "<</ROLE>>"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out, pos = [], 0
    while pos < len(formatted):
        m = _OPEN.match(formatted, pos)
        if not m:
            raise ValueError(f"no turn begins at {pos}")
        mark = m.group()
        close = _CLOSE.get(mark, "<</ROLE>>\n")
        end = formatted.index(close, m.end())
        out.append((_ROLE_OF.get(mark) or unquote(m.group(1) or ""), unescape(formatted[m.end():end])))
        pos = end + len(close)
    return out


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the byte spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = frame(role)
        body = escape(text or "")
        begin = at + len(before.encode("utf-8"))
        end = begin + len(body.encode("utf-8"))
        if role == "assistant":
            spans.append((begin, end))
        parts.append(f"{before}{body}{after}\n")
        at = end + len(after.encode("utf-8")) + 1
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], lengths: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span; lengths are the tokens' byte lengths in order."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros(len(lengths), bool)
    for begin, end in spans:
        if end > begin:
            out[np.searchsorted(ends, begin, "right"):np.searchsorted(starts, end, "left")] = True
    return out


def masked_texts(pieces: list[bytes], loss: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """Text under the mask, read from the tokens, one string a span, unescaped."""
    ends = np.cumsum([len(p) for p in pieces]) if pieces else np.zeros(0, int)
    out = []
    for begin, end in spans:
        a = int(np.searchsorted(ends, begin, "right"))
        b = int(np.searchsorted(ends, end, "left")) + 1 if end > begin else a
        first = int(ends[a - 1]) if a else 0
        raw = b"".join(p for p, under in zip(pieces[a:b], loss[a:b]) if under)
        out.append(unescape(raw[begin - first:end - first].decode("utf-8")))
    return out


def format_conversations(rows: DataFrame, path: str, pattern: str, block_chars: int = 4_000_000) -> DataFrame:
    """One row (FORMATTED) a conversation, more for giant ones, in order within the partition."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    dealt = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                        F.col("text").cast("string"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(vocabulary.value, pattern)
        now, begun, block, turns, size = None, False, 0, [], 0
        done: list[tuple] = []

        def close() -> None:
            text, spans = render(turns)
            ids = bpe.encode(text)
            loss = mask(spans, np.array([len(bpe.bytes_of[i]) for i in ids], np.int64))
            done.append((now, block, text, ids, loss.tolist(), [{"begin": a, "end": b} for a, b in spans]))

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 2, 3)]
            for conv, role, text in zip(*cols):
                if begun and conv != now:
                    close()
                    turns, size, block, begun = [], 0, 0, False
                elif begun and size >= block_chars:
                    close()
                    turns, size, block = [], 0, block + 1
                now, begun = conv, True
                turns.append((role, text))
                size += len(text or "")
            if done:
                yield _batch(done, schema)
                done.clear()
        if begun:
            close()
            yield _batch(done, schema)

    return dealt.mapInArrow(run, FORMATTED)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("formatted", pa.string()),
                      ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
                      ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_tokens long, n_loss_tokens long")


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Turns and masked text read from the output of format_conversations, as digests (DIGESTS).

    Blocks of a conversation lie in one partition in order, so the hashes are
    carried from block to block.
    """
    vocabulary = formatted.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(vocabulary.value, pattern)
        schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64())
                            for name, kind in map(str.split, DIGESTS.split(", "))])
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, size, tokens, under = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, under))

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for conv, block, text, ids, under, spans in zip(*cols):
                if block == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8"))
                pieces = [bpe.bytes_of[i] for i in ids]
                for body in masked_texts(pieces, np.array(under, bool), [(s["begin"], s["end"]) for s in spans]):
                    state[3] += len(body)
                    state[4].update(body.encode("utf-8"))
                state[5] += len(text)
                state[6] += len(ids)
                state[7] += sum(under)
            if done:
                yield _batch(done, schema)
                done.clear()
        if state:
            close()
            yield _batch(done, schema)

    return formatted.mapInArrow(run, DIGESTS)
