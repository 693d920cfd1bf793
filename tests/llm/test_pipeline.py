"""Each pipeline stage against a plain version, on the given table and on odd rows."""

import hashlib

import public_tokenizers
import pytest
import zstandard

import corpus_pipeline as P
from replytime.llm import bpe, langid, quality
from replytime.llm.queries import vocabulary_path

from ..conftest import SF001
from .test_shingle_join import plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [[tuple(r) for r in docs.select(*COLUMNS).collect()]]
    for name, stage in P.STAGES:
        df = stage(spark, docs, SF001)
        if name != P.STAGES[-1][0]:
            assert df.columns == COLUMNS
        df.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "shingle_join", "source_mix", "byte_bpe"]
    assert P.ORACLE_SQL is None


def test_language_stage_keeps_what_has_letters(stages):
    clear = {r for r in stages[0] if r[1] and any(c.isalpha() for c in r[1])}
    assert set(stages[1]) <= clear and len(stages[1]) >= 0.99 * len(clear)


def test_quality_stage(stages):
    pack = zstandard.ZstdCompressor(level=quality.LEVEL)
    assert sorted(stages[2]) == sorted(r for r in stages[1] if quality.judge(r[1], pack)[6])


def test_near_copies_stage(stages):
    rows = sorted(stages[2])
    parts = plain_components([(r[0], r[1]) for r in rows])
    assert sorted(stages[3]) == [r for r, (_, c) in zip(rows, parts) if r[0] == c]


def test_mix_and_tokens(stages):
    assert set(stages[4]) <= set(stages[3]) and len(stages[4]) > 0.5 * len(stages[3])
    coder = bpe.ByteBpe(bpe.read_ranks(bpe.vocabulary_bytes(vocabulary_path())), public_tokenizers.PATTERN)
    want = []
    for r in stages[4]:
        ids = coder.encode(r[1])
        want.append((r[0], ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(r[1].encode()).hexdigest()))
    assert sorted(stages[5]) == sorted(want)


def test_odd_rows_in_every_stage(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size int, found string, row string"
    prose = "The bridge over the river was built of stone and silver paper in a winter of music. "
    text = "".join(prose[k:] + str(k * 7919) + " " + prose[::-1][k:k + 40] for k in range(12))
    rows = [(1, None, "en", None, None, 1, "x", "y"), (2, "", None, "s", 0, 1, None, None), (3, "12 !", "en", "s", 4, 1, "", ""),
            (None, text, "en", "s", 1, 2, "a", "b"), (None, text, "en", "s", 1, 2, "a", "b"), (5, text, "en", None, 1, 2, "a", "b"),
            (6, text.upper(), "en", "s", 1, 2, "a", "b")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for k, (_, stage) in enumerate(P.STAGES):
            df = stage(spark, docs, SF001)
            if k < 4:
                assert df.columns == docs.columns
            df.write.parquet(f"{tmp_path}/{len(given)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(given)}-{k}")
        if not given:
            assert docs.count() == 0


def test_run(spark, stages):
    out = P.run(spark, SF001)
    assert sorted(tuple(r) for r in out.collect()) == sorted(stages[5])
    assert langid.UNKNOWN == "und"
