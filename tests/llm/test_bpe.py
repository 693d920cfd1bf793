"""Byte-level BPE against tiktoken, and exact round trips."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from replytime.llm import bpe
from replytime.llm.queries import op2_byte_bpe, vocabulary_path

from ..conftest import SF0001


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(bpe.read_ranks(bpe.vocabulary_bytes(vocabulary_path())), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=200))
def test_any_text_equals_tiktoken(coder, oracle, text):
    ids = coder.encode(text)
    assert ids == oracle.encode_ordinary(text)
    assert coder.decode(ids) == text.encode("utf-8")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst", max_size=80))
def test_long_pieces_equal_tiktoken(coder, oracle, text):
    assert coder.encode(text) == oracle.encode_ordinary(text)


def test_pairs_checked_backwards_equal_merging(coder):
    import random
    rnd = random.Random(7)
    assert coder._ordered
    tokens = [r for b, r in coder.ranks.items() if coder._size[r]]
    likely = [(a, b) for a in rnd.sample(tokens, 300) for b in rnd.sample(tokens, 30)]
    for ids in (coder.encode_piece(b"thblerionandwhentionouerst" * 3), coder.encode_piece("überflüssigkeitschaft".encode() * 4)):
        likely += list(zip(ids, ids[1:]))
    for left, right in likely:
        pair = [coder.bytes_of[left], coder.bytes_of[right]]
        assert coder._meets(left, right) == (coder._merge(b"".join(pair))[0] != pair)


def test_very_long_pieces(coder, oracle):
    for text in ("a" * 20_000, " " * 5_000 + "x", "äöü€😀" * 2_000, "the" * 9_000, "\n" * 3_000):
        assert coder.encode(text) == oracle.encode_ordinary(text)


def test_full_memo_does_not_change_ids(coder, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    text = "unusual wordforms like zxqvorn and thblerion keep emptying memos " * 3
    assert coder.encode(text) == oracle.encode_ordinary(text)


def test_query_digests(spark, oracle):
    got = {r["doc_id"]: r for r in op2_byte_bpe(spark, SF0001).collect()}
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect():
        ids = oracle.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "ab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coded string")
    out = bpe.encode_documents(docs, vocabulary_path(), public_tokenizers.PATTERN).orderBy("text").collect()
    assert [(r["text"], r["token_ids"], bytes(r["decoded"]), r["coded"]) for r in out] == [
        (None, [], b"", "x"), (None, [], b"", "x"), ("", [], b"", "y"), ("ab", [397], b"ab", None)]
    none = bpe.encode_documents(docs.limit(0), vocabulary_path(), public_tokenizers.PATTERN)
    assert none.count() == 0
