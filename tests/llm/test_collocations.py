"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import duckdb
import pytest

from replytime.llm import collocations, oracles
from replytime.llm.queries import op12_phrase_collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, top=2000, share=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k:k + m])] += 1
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in frequent.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                key = lang, p[k:k + m]
                inside[key] = max(inside[key], a)
    found = {}
    for (lang, p), a in frequent.items():
        if inside[lang, p] and 100 * inside[lang, p] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, ps in found.items()
            for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top], 1)}


def texts(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "The", "a", "of", "old", "Óld", "tea", "pot\t", "b-c", "ab", "x" * 40, "né"]
    stops = [" ", " ", " ", "  ", ". ", ",", "\n", "\r\n", " \t", "\x0b", "!? "]
    return [(i, "".join(rng.choice(words) + rng.choice(stops) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "fr", None, "und"])) for i in range(docs)]


@pytest.mark.parametrize("sizes", [{}, {"small_rows": -1, "bucket_words": 50}, {"bucket_words": 100}])
def test_equals_plain_counts(spark, sizes):
    rows = texts(3)
    for least, share, top in [(3, 100, 2000), (2, 60, 7)]:
        made = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=least, share=share, top=top, **sizes)
        got = {tuple(r) for r in made.collect()}
        assert got == plain(rows, least, share=share, top=top)
        assert made.count() == len(got) > 0


def test_edges(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None), (1, "", "en"), (1, " \t\n.,", "en")] + [(None, "Be there, be there then", None)] * 4
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "lang", "1 AS pos", "2 AS word", "3 AS g", "4 AS a")
    got = {tuple(r) for r in collocations.collocations(docs, least=4).collect()}
    assert got == plain(rows, 4)
    assert {r[2] for r in got} == {"be there", "be there then"}


def test_long_text_and_hot_phrase(spark):
    rows = [(1, "one two three " * 40_000, "en")] + [(i, "one two", "en") for i in range(200)]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA), bucket_words=20_000).collect()}
    assert got == plain(rows, 100)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    groups = spark.createDataFrame(
        [("en", "a b c", big, 7 * big, [big, 2 * big], [5 * big, big])],
        "lang string, phrase string, a long, n long, firsts array<long>, rests array<long>")
    row = collocations._scored(groups).first()
    scores = [1000 * big * 7 * big // (big * 5 * big), 1000 * big * 7 * big // (2 * big * big)]
    assert (row["score"], row["l"], row["r"]) == (min(scores), big, 5 * big)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {tuple(r) for r in op12_phrase_collocations(spark, sf).collect()}
    assert got == plain(docs, 100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    columns = "lang, rank, phrase, a, l, r, n, score"
    assert set(con.execute(f"SELECT {columns} FROM ({oracles.COLLOCATIONS})").fetchall()) == got


def test_no_exchange_between_neighbours_and_settings_stay(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with collocations._relations(spark) as database:
        rows = spark.range(1000).selectExpr("id % 10 AS doc", "cast(id AS int) AS pos", "id AS g")
        kept = collocations._persist(rows, f"{database}.t", 3)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = collocations._adjacent(kept)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get(key) == before
