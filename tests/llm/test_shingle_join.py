"""The shingle join against all pairs on small tables."""

import random
import re
import string

import numpy as np
import pytest

from replytime.llm import shingle_join, shingles
from replytime.llm.queries import op5_shingle_join

from ..conftest import SF0001

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def plain_components(rows):
    """(n_shingles, component) of each row, comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return [(len(s), least[root(k)]) for k, s in enumerate(sets)]


def family_rows(seed, n=150):
    """Texts of a few families with edits around the limit, copies, shared passages and strangers."""
    rnd = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(3000)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([5, 8, 30, 60, 120]))] for _ in range(8)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.2:
            words = passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 20))]
        if rnd.random() < 0.2:
            words = words[:rnd.randint(0, len(words))]
        rows.append((1000 - i * 3, rnd.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_hashes_equal_words_and_shingles(monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", "  ", "a", "Ab c"] + ["".join(rnd.choice("abÀß\u00a0 \n\tXY") for _ in range(rnd.randint(0, 300)))
                                             for _ in range(400)]
    whole = shingles.shingle_sets(texts)
    assert [len(s) for s in whole] == [len(plain_set(t)) for t in texts]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(texts)))


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, small):
    if small:  # hot shingles, split rings and slices come into play
        for name, value in (("RING", 3), ("SLICE", 5)):
            monkeypatch.setattr(shingle_join, name, value)
        monkeypatch.setattr(shingle_join.hot_shingles, "__defaults__", (4096, 4))
    rows = family_rows(seed)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.shingle_join(docs).collect()}
    want = {i: w for (i, _), w in zip(rows, plain_components(rows))}
    assert got == want


def test_rings_alone_find_what_pivots_leave(spark):
    """y is beyond the radius of the pivot, x inside it, and they link."""
    base = ["b%d" % k for k in range(200)]

    def changed(at):
        return " ".join("x%d" % k if k in at else w for k, w in enumerate(base))

    # edits at the ends cost few shingles each; 1 and 2 link only through 3
    rows = [(1, changed(range(0, 22))), (2, changed(range(178, 200))), (3, changed(())), (4, changed(range(0, 34))),
            (5, changed(range(0, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.shingle_join(docs).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, plain_components(rows))}


def test_edge_rows_and_one_of_each(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (7, "A b", "x"), (5, "a B", "x"), (9, "a c", "x"),
            (9, "a c", "x"), (4, "one two three four five six", "x"), (None, "one two three four five six", "x"),
            (None, "lonely words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep__x string")
    got = [tuple(r) for r in shingle_join.shingle_join(docs).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, 1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (7, 1, 5), (5, 1, 5), (9, 1, 9), (9, 1, 9), (4, 2, 4),
        (None, 2, 4), (None, 1, None)], key=str)
    kept = [tuple(r)[:2] for r in shingle_join.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, None), (1, None), (2, ""), (3, " \n"), (5, "a B"), (9, "a c"),
                                            (4, "one two three four five six"), (None, "lonely words here")], key=str)
    assert shingle_join.shingle_join(docs.limit(0)).count() == 0


def test_one_of_each_ranks_no_whole_rows(spark):
    rows = [(k, [None, "", "\x0b \t"][k % 3], f"c{k}") for k in range(30)] + [(50, "the same text", f"d{k}") for k in range(20)]
    kept = shingle_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_min_by") == 1
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == 31 and {r for r in got if r[0] < 30} == set(rows[:30])
    assert [r in rows[30:] for r in got if r[0] == 50] == [True]


def test_rows_without_ids_still_link_others(spark):
    base = ["b%d" % k for k in range(100)]
    rows = [(7, " ".join(["x%d" % k if k < 9 else w for k, w in enumerate(base)])), (None, " ".join(base)),
            (9, " ".join(["y%d" % k if k > 90 else w for k, w in enumerate(base)])), (None, "a text of no one else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["n_shingles"]: r["component_id"] for r in shingle_join.shingle_join(docs).collect() if r["doc_id"] is None}
    ids = {r["doc_id"]: r["component_id"] for r in shingle_join.shingle_join(docs).collect() if r["doc_id"]}
    assert ids == {7: 7, 9: 7} and got == {96: 7, 2: None}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_shingle_join(spark, SF0001).collect()}
    assert got == {i: w for (i, _), w in zip(rows, plain_components(rows))}
