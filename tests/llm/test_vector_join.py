"""The vector join against all pairs, with cells and parts made small."""

import numpy as np
import pytest

from replytime.llm import vector_join
from replytime.llm.queries import op10_vector_join

from ..conftest import SF0001


def plain(rows):
    """vec_id -> (n_links, component) from all pairs; ids are unique."""
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float), lab) for i, v, lab in rows if usable(v, lab)]
    links: dict[int, set] = {i: set() for i, _, _ in rows}
    for a, (i, u, la) in enumerate(good):
        for j, w, lb in good[:a]:
            if la == lb and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[i] = (len(links[i]), min(seen))
    return out


def families(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(14):
        center = rng.normal(size=6)
        for _ in range(12):
            v = center + rng.normal(size=6) * rng.choice([0.0, 0.05, 0.15, 0.3])
            rows.append((v * rng.choice([1.0, 7.5])).tolist())
    order = rng.permutation(len(rows))
    return [(int(order[k]) + 5, v, k % 2) for k, v in enumerate(rows)]


@pytest.mark.parametrize("seed, cell, part", [(1, 512, 1024), (2, 4, 3), (3, 10, 1000)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, cell, part):
    for name, value in (("CELL", cell), ("PART", part), ("SLICE", part + 2)):
        monkeypatch.setattr(vector_join, name, value)
    rows = families(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, point string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.vector_join(df).collect()}
    assert got == plain(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, -0.0], 0), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0),
            (12, [1e200, 0.0], 0), (13, [1e-200, 1e-210], 0), (14, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_join.vector_join(df).collect()}
    for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 14):
        assert got[i] == (0, i, True), i
    assert {got[i] for i in (9, 12, 13)} == {(3, 8, False)} and got[8] == (3, 8, True)
    assert vector_join.vector_join(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)],
                                  "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in vector_join.vector_join(twice).collect()) == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_query(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"])
            for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op10_vector_join(spark, SF0001).collect()}
    assert got == plain(rows)


def test_work_of_a_point_is_bounded_in_one_label(spark, monkeypatch):
    """Near families around many centers: cells stay small however many points a label has."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(vector_join, "CELL", 128)
    work = {}
    for n in (1000, 4000, 16000):
        rng = np.random.default_rng(n)
        centers = rng.normal(size=(n // 10, 3))
        v = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, 3)) * 0.005
        rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
        pts = vector_join.points(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        cells = vector_join.divided(vector_join.labels(pts.withColumn("point", F.xxhash64("label", "v"))), 0.9995)
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("h"))
        total, home = sizes.agg(F.sum(F.col("n") * F.col("h")), F.sum("h")).first()
        assert home == n
        work[n] = total / n
    assert max(work.values()) <= 3 * 128, work


def test_many_labels(spark):
    rows = [(i, [1.0, float(i % 3)], i // 4) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.vector_join(df).collect()}
    assert len(got) == 8000
    for k in range(0, 8000, 4):
        same = [i for i in range(k, k + 4) if i % 3 == k % 3]
        assert got[k] == (len(same) - 1, k)
