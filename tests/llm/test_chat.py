"""Chat formatting: reversible, aligned, the same for any block size."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from replytime.llm import bpe, chat
from replytime.llm.queries import op7_chat_format, vocabulary_path

from ..conftest import SF0001

PARTS = st.lists(st.sampled_from(["<", "<<", "[", "/", "\\", "s>", "INST]", "SYS>>", "ROLE:", "ROLE>>", "x", " ", "\n",
                                  "ü", "</s>", "[/INST]", "<<ROLE:a>>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool>>", "User", ""]), PARTS), max_size=5))
def test_turns_and_masked_texts_read_back(turns):
    text, spans = chat.render(turns)
    assert chat.read_turns(text) == turns
    pieces = [text.encode()[k:k + 3] for k in range(0, len(text.encode()), 3)]
    loss = chat.mask(spans, np.array([len(p) for p in pieces], int))
    assert chat.masked_texts(pieces, loss, spans) == [t for r, t in turns if r == "assistant"]
    under = {k for k, on in enumerate(loss) if on}
    touching = {b // 3 for a, e in spans for b in range(a, e)}
    assert under == touching


def want(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    made = chat.format_conversations(df, vocabulary_path(), public_tokenizers.PATTERN, **kw)
    back = chat.read_back(made, vocabulary_path(), public_tokenizers.PATTERN).collect()
    return made, {r["conv_id"]: tuple(r)[1:] for r in back}


def test_blocks_give_the_ids_of_the_whole(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} </s> text\n\n  ", None) for k in range(30)]
    whole, a = got(spark, rows)
    parts, b = got(spark, rows, block_chars=40)
    assert a == b and parts.count() > 5 and whole.count() == 1
    ids = [i for r in sorted(parts.collect(), key=lambda r: r["block"]) for i in r["token_ids"]]
    assert ids == whole.first()["token_ids"]
    coder = bpe.ByteBpe(bpe.read_ranks(bpe.vocabulary_bytes(vocabulary_path())), public_tokenizers.PATTERN)
    assert ids == coder.encode(whole.first()["formatted"])


def test_edge_rows(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "a", "x"), (None, 5, "user", "n", None),
            (None, 5, "assistant", "n", None), (2, 0, "assistant", "same", None), (2, 0, "assistant", "same", None),
            (3, None, "user", "", None)]
    _, out = got(spark, rows)
    assert out[1][:4] == want([(None, "a"), ("assistant", None)])
    assert out[None][:4] == want([("assistant", "n"), ("user", "n")])
    assert out[2][:4] == want([("assistant", "same")] * 2)
    assert out[3][:4] == want([("user", "")])
    assert got(spark, [(1, 0, "user", "x", None)])[0].limit(0).count() == 0


def test_query(spark):
    out = {r["conv_id"]: r for r in op7_chat_format(spark, SF0001).collect()}
    rows: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF0001}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(out) == set(rows)
    for conv, turns in rows.items():
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want(turns)
        assert r["formatted_chars"] == len(chat.render(turns)[0])
