"""K-d tree shards against a plain tree over sorted lists."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from replytime.llm import sharding
from replytime.llm.queries import op13_kd_shards

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_split(points, leaves, pins=sharding.PINS):
    """points: (id, w, tie, coordinates); shards by recursion over sorted lists."""
    dims = len(points[0][3])

    def spread(part, d):
        w = sum(p[1] for p in part)
        mean = sum(p[1] * p[3][d] for p in part) / w
        return sum(p[1] * p[3][d] ** 2 for p in part) / w - mean * mean

    root = [spread(points, d) for d in range(dims)]
    shards = {}

    def go(part, first, k):
        if k == 1 or not part:
            shards.update({p[0]: first for p in part})
            return
        shares = [round(spread(part, d) / root[d], 9) if root[d] > 0 else 0.0 for d in range(dims)]
        dim = shares.index(max(shares))
        key = lambda p: (p[3][dim], p[2])
        rest, goal, sides = sorted(part, key=key), sum(p[1] for p in part) * (k // 2) / k, {}
        for again in range(pins + 1):
            below = 0
            for at, p in enumerate(rest):
                if below + p[1] >= goal:
                    break
                below += p[1]
            else:
                at, p = len(rest), None
            if p is None:
                break
            over, short = below + p[1] - goal, goal - below
            if again == pins or min(abs(over), abs(short)) <= 0:
                at += over < short
                break
            sides[p[0]] = over < short
            goal = max(0.0, goal - p[1]) if over < short else goal
            rest.remove(p)
        left_ids = {p[0] for p in rest[:at]} | {i for i, s in sides.items() if s}
        go([p for p in part if p[0] in left_ids], first, k // 2)
        go([p for p in part if p[0] not in left_ids], first + k // 2, k - k // 2)

    go(points, 0, leaves)
    return shards


@pytest.mark.parametrize("leaves, seed", [(2, 1), (5, 2), (16, 3)])
def test_split_equals_plain_tree(spark, leaves, seed):
    rng = random.Random(seed)
    points = [(i, rng.choice([1, 2, 3, 50, 400]), rng.getrandbits(sharding.TIE_BITS),
               (rng.choice([0, 5, 2 ** 20 - 1]), rng.getrandbits(20), rng.getrandbits(3))) for i in range(200)]
    table = spark.createDataFrame([(i, 0, w, t, *x) for i, w, t, x in points], "g long, part long, w long, tie long, x_0 long, x_1 long, x_2 long")
    got = {r.g: r.shard for r in sharding.split(table, leaves, slack=0.0).collect()}
    assert got == plain_split(points, leaves)
    sizes = [sum(w for i, w, _, _ in points if got[i] == s) for s in range(leaves)]
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes) / leaves + 8


def check(rows, leaves=16):
    """Every row once, slots gapless, sizes and checksums right."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < leaves
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op13_kd_shards(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(rows)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    bytes_ = [0] * 16
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        bytes_[r.shard] += r.size
    assert max(bytes_) <= 1.05 * min(bytes_)  # the longest document is a fifth of a shard


def test_hot_group_is_split_and_small_groups_stay(spark):
    rng = random.Random(5)
    hot = "same text " * 20
    rows = [(i, hot, "en", f"s{i % 3}") for i in range(2000)]
    rows += [(5000 + i, f"text {i % 1000} " + "word " * (i % 1000 % 40), rng.choice(["en", "fr"]), f"s{i % 7}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got)
    sizes, where = [0] * 16, {}
    for r in got:
        sizes[r.shard] += r.size
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert max(sizes) <= 1.03 * min(sizes)
    assert len(where.pop((zlib.crc32(hot.encode()), len(hot) + 1))) >= 3
    # groups of up to a 64th of a leaf stay whole
    small = [k for k in where if 4 * k[1] <= sum(sizes) // (16 * sharding.UNITS_A_LEAF)]
    assert len(small) > 500 and all(len(where[k]) == 1 for k in small)


def test_edges(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None)] * 40 + [(1, "", "en", None), (1, "", "en", None), (2, "é" * 100_000, None, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS shard", "3 AS g", "4 AS part", "5 AS rid", "6 AS row")
    got = sharding.shard(docs, leaves=4, keep=tuple(docs.columns))
    assert got.columns == ["doc_id", "text", "lang", "source", "g", "part", "rid", "row", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(got.collect(), 4)
    assert {(r.doc_id, r.size) for r in got.collect()} == {(None, 1), (1, 1), (2, 200_001)}
    assert got.where(F.col("doc_id").isNull()).select("shard").distinct().count() == 1


def test_target_bytes_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 90), "en", "a") for i in range(3000)], SCHEMA)
    total = sum(i % 90 + 1 for i in range(3000))
    sharding.write_shards(docs, str(tmp_path / "out"), target_bytes=10_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = [r[0] for r in back.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == math.ceil(total / 10_000) and max(sizes) <= 10_300 and back.count() == 3000
    assert back.select("text").exceptAll(docs.select("text")).count() == 0
