"""Kernel density of continuous values through nodes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.operators.plotdata import kde_density, to_nodes


def test_nodes_keep_within_the_bound(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 0.3, 1000), [250.0]])
    df = spark.createDataFrame([(g, float(v)) for g in ("a", "b") for v in (x if g == "a" else x[:500] * 1e3)], "g string, x double")
    exact = {(r.g, r.j): r for r in kde_density(df, "x", by=("g",)).collect()}
    for fine in (4, 64):
        got = kde_density(df, "x", by=("g",), few=100, fine=fine).collect()
        assert len(got) == len(exact)
        worst = 0.0
        for r in got:
            e = exact[r.g, r.j]
            assert abs(r.bw - e.bw) < 1e-9 * e.bw and abs(r.x - e.x) < 1e-6 * max(1, abs(e.x))
            worst = max(worst, abs(r.density - e.density) * e.bw)
        assert 0 < worst <= 1 / (8 * math.sqrt(2 * math.pi) * fine ** 2) + 1e-12


def test_mass_is_kept_without_groups_and_for_one_value(spark):
    df = spark.createDataFrame([(float(i % 997) / 7,) for i in range(5000)], "x double")
    for one in (df, df.where("x = 0")):
        out = kde_density(one, "x", few=0, n_grid=400).orderBy("x").collect()
        step = out[1].x - out[0].x
        assert abs(sum(r.density for r in out) * step - 1) < 0.02


def test_nodes_do_not_grow_with_distinct_values(spark):
    for n in (5_000, 200_000):
        values = spark.range(n).select((F.col("id") * (40.0 / n)).alias("x"), F.lit(1).alias("c"), F.lit(n).alias("n"),
                                       F.lit(1.0).alias("bw"), F.lit(-3.0).alias("g0"), F.lit(0.09).alias("step"))
        nodes, mass, centre = to_nodes(values, (), 8).agg(F.count("*"), F.sum("c"), F.sum(F.expr("c * x")) / F.sum("c")).first()
        assert nodes <= 40 * 8 + 2
        assert abs(mass - n) < 1e-6 * n and abs(centre - 20.0 * (n - 1) / n) < 1e-6  # linear: the mean stays


def test_fine_is_checked(spark):
    with pytest.raises(ValueError, match="fine"):
        kde_density(spark.range(3), "id", fine=0)
