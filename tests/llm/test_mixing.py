"""Source mix: targets by plain resharing, quotas, disjoint draws, reruns."""

import random
import re
from collections import Counter

import pytest

from replytime.llm import mixing
from replytime.llm.queries import op8_source_mix

from ..conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict) -> dict:
    """Shares by weight; what exceeds 3 times a source is shared again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def checked(rows, out, exact=True):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        copies = -(-r["taken"] // r["size"]) if r["size"] else 0
        assert len(r["shards"]) == copies and all(0 <= k < 16 for k in r["shards"])
        taken[r["source"]] += r["taken"]
    if exact:
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 1


def test_quotas_and_shards(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["a", "B", "é", "z", None, "tiny"][:rnd.choice([2, 5])]))
            for i in range(400)] + [(9000, "one word only", "tiny"), (9001, "", "void"), (9002, None, "void")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, at string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    checked(rows, out)
    again = {r["doc_id"]: tuple(r) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: tuple(r) for r in out}
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] for r in out)


def test_shards_are_even_and_draws_match(spark):
    mixed = mixing.mix(spark.read.parquet(f"{SF001}/documents.parquet"))
    out = mixed.collect()
    shard = Counter(k for r in out for k in r["shards"])
    assert len(shard) == 16 and max(shard.values()) < 1.5 * min(shard.values())
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in out}
    drawn = Counter(r["doc_id"] for r in mixing.draw(mixed).collect())
    assert drawn == Counter({i: n for i, n in copies.items() if n})


def test_tree_deals_every_copy_once(spark):
    copies = spark.createDataFrame([("a", k, k % 4) for k in range(40)] + [(None, 0, 3)],
                                   "source string, block long, copies long")
    out = mixing.deal(copies, levels=3).collect()
    assert {(r["source"], r["block"]): len(r["shards"]) for r in out} == {
        **{("a", k): k % 4 for k in range(40) if k % 4}, (None, 0): 3}
    shard = Counter(k for r in out for k in r["shards"])
    assert set(shard) == set(range(8)) and max(shard.values()) - min(shard.values()) <= 1


def test_edge_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (None, "a b c", "s"), (1, None, None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == 5
    checked(rows, out)
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(docs.where("text is null or text = ''")).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 and r["shards"] == [] for r in nothing) and len(nothing) == 2


def test_query_is_native(spark):
    df = op8_source_mix(spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    source = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = [(i, *v) for i, v in source.items()]
    out = [{**r.asDict(), "source": source[r["doc_id"]][1]} for r in df.collect()]
    checked(rows, out)
