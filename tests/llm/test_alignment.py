"""Alignment of two tokenizers against a plain walk over bytes, tokens made by the libraries alone."""

import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from replytime.llm import alignment
from replytime.llm.queries import op11_token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def byte_of():
    chars, n = {}, 0
    for b in range(256):
        if chr(b).isprintable() and b != 32 and b != 173:
            chars[chr(b)] = b
        else:
            chars[chr(256 + n)] = b
            n += 1
    return chars


def plain(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    of = byte_of()
    done = []
    for text in texts:
        if not text:
            done.append(None)
            continue
        whole = (" " + text).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        a_of = [bytes(of[c] for c in a_tok.id_to_token(x)) for x in a]
        b_of = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else
                b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(a_of) != whole or b"".join(b_of) != whole:
            done.append(None)
            continue
        at_a = [k for k, x in enumerate(a_of) for _ in x]  # token of each byte
        at_b = [k for k, x in enumerate(b_of) for _ in x]
        links = sorted(set(zip(at_a, at_b)))
        ends = [i + 1 for i in range(len(whole)) if (i + 1 == len(whole) or at_a[i] != at_a[i + 1] and at_b[i] != at_b[i + 1])]
        groups, start = [], 0
        for e in ends:
            groups.append(",".join(str(a[k]) for k in sorted(set(at_a[start:e]))) + "|" +
                          ",".join(str(b[k]) for k in sorted(set(at_b[start:e]))))
            start = e
        done.append((a, b, groups, [(a[i], b[k]) for i, k in links]))
    counts = Counter(p for d in done if d for p in d[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (
        len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]),
        hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in done]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [None, "", " ", "  ", "a", " a", "a  b", "<|endoftext|> x</s><s><unk> <0x41>", "tab\there\nline\r\n", "日本語 のテキスト", "naïve café Ünïcode",
        "🙂🙂 emoji‍", "▁ mark", "x" * 300, "don't we'll I'm 1234567", "a" * 50_000, "word " * 20_000, "\x00null", "ﬁ ﷺ", "  nbsp",
        "trailing  ", "\n\n\n", "== ==", "é", "same words here", "same words here"]


def test_equals_plain_walk(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B).collect()}
    assert [got[k] for k in range(len(HARD))] == plain(HARD)
    assert sum(g[0] > 0 for g in got.values()) > 15


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op11_token_alignment(spark, sf)
    assert rows.columns[:8] == ["doc_id", *COLUMNS]
    assert {t: k for t, k in rows.dtypes if t != "groups_sha256"} == dict.fromkeys(["doc_id", *COLUMNS[:-1]], "bigint")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))


def test_memo_and_small_calls_change_nothing(spark, monkeypatch):
    def made():
        al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
        texts = [t for t in HARD if t]
        return [al.documents([t], groups=True)[0][:5] for t in texts], [r[:5] for r in al.documents(texts)]

    whole = made()
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 3)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 4)
    assert made() == whole
    monkeypatch.setattr(alignment, "CALL_CHARS", 10)
    found = list(alignment.calls(HARD))
    assert sorted(k for c in found for k in c) == [k for k, t in enumerate(HARD) if t] and max(map(len, found)) <= 10


def test_windows_begin_at_shared_spaces():
    al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    import numpy as np
    (a, b), = al.encode(["several plain words follow"])
    i, k = [x.tolist() for x in al.anchors(a, np.array(b))]
    assert i[0] == k[0] == 0 and i[-1] == len(a) and k[-1] == len(b) and len(i) == 5
    for x, y in zip(i[:-1], k[:-1]):
        assert al.a_bytes[a[x]][:1] == b" " == al.b_bytes[b[y]][:1]
        assert sum(len(al.a_bytes[t]) for t in a[:x]) == sum(len(al.b_bytes[t]) for t in b[:y])


def test_ranks_give_the_ids_of_the_file_on_settled_characters():
    al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    assert al.fast is not None
    near = ["", " ", "  ", "a", "1", "'", "\n", "é"]
    texts = [" " + x + chr(c) + y for c in range(0x250) for x in near for y in near]
    assert not any(alignment.SETTLED.search(t) for t in texts) and alignment.SETTLED.search("\u0250")
    made = al.a.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.ids for x in made] == [al.fast.encode_ordinary(t) for t in texts]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(HARD)), SCHEMA)
    monkeypatch.setattr(alignment, "SMALL_PAIRS", -1)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B).collect()}
    assert [got[k] for k in range(len(HARD))] == plain(HARD)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rid", "2 AS pairs", "3 AS n_a", "4 AS row", "5 AS aligned")
    made = alignment.align(docs, A, B, keep=tuple(docs.columns), groups=True)
    assert made.columns == ["doc_id", "text", "rid", "pairs", "row", "aligned", *COLUMNS, "groups"]
    assert [(r.n_a, r.n_best, r.groups_sha256) for r in made.collect()] == [(0, 0, "")] * len(rows)


def test_words_are_encoded_once_wherever_they_stand():
    al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    made, sizes = al.encode, []
    al.encode = lambda texts: sizes.append(sum(map(len, texts))) or made(texts)
    words = [f"word{k}s" for k in range(300)]
    texts = [" ".join(words[(k * x) % 300] for x in range(2_000)) for k in (1, 7, 11)]
    texts.append(words[5] + " " + words[9])
    rows = al.documents(texts[:3]) + al.documents(texts[3:])
    assert sum(sizes) < 2 * sum(len(w) + 1 for w in words)
    assert [r[:5] for r in rows] == [(*r[:4], r[6]) for r in plain(texts)]


def test_words_give_what_whole_texts_give(monkeypatch):
    al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    assert al.divides
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "​", "a", "word", "'s", "don't",
             "12", ".", "==", "é", "é", "日本", "ɐ", "\U0001f642", "▁", "<s>"]
    draw = random.Random(11)
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 9))) for _ in range(20_000)]
    texts += ["".join(x) for x in itertools.product(parts, repeat=2)]
    whole = [r[:5] for r in al._whole(texts, False)]
    assert [r[:5] for r in al.documents(texts)] == whole
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 500)
    assert [r[:5] for k in range(0, len(texts), 50) for r in al.documents(texts[k:k + 50])] == whole
    monkeypatch.setattr(alignment, "TEXT_WORDS", 1)
    al.forget()
    assert [r[:5] for r in al.documents(texts)] == whole
    some = [k for k, t in enumerate(texts) if k % 20 == 0 and "▁" not in t]
    assert [whole[k] for k in some] == [(*r[:4], r[6]) for r in plain([texts[k] for k in some])]


def test_other_piece_models_are_given_whole_texts():
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(B, "rb").read()
    assert alignment._pieces_divide(raw)
    model = pb.ModelProto.FromString(raw)
    changed = [pb.ModelProto.FromString(raw) for _ in range(5)]
    changed[0].trainer_spec.model_type = model.trainer_spec.UNIGRAM
    changed[1].trainer_spec.treat_whitespace_as_suffix = True
    changed[2].normalizer_spec.remove_extra_whitespaces = True
    changed[3].pieces[-1].piece = "x▁y"
    changed[4].pieces[-1].type = pb.ModelProto.SentencePiece.USER_DEFINED
    assert not any(alignment._pieces_divide(m.SerializeToString()) for m in changed)
    al = alignment.Aligner(open(A, "rb").read(), changed[4].SerializeToString())
    assert not al.divides and al.documents(["some words"])[0][:2] == tuple(map(len, al.encode(["some words"])[0]))
