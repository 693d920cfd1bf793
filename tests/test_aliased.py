"""Aliased design terms: the fit without them, NULL in their place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from replytime.models.design import Factor, Numeric, build_design
from replytime.models.glm import fit_logit
from replytime.models.lm import fit_lm
from replytime.models.suffstats import independent


def test_independent_columns_of_a_gram_matrix():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) * [1, 1e3, 1e-3, 1, 1, 1] + [0, 1e5, 0, 0, 0, 0]
    x[:, 3] = 2 * x[:, 0] - x[:, 2]
    x[:, 5] = 0
    assert independent(x.T @ x) == [0, 1, 2, 4]
    full = rng.normal(size=(50, 5))
    assert independent(full.T @ full) == [0, 1, 2, 3, 4]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for _ in range(600):
        level = "abc"[int(rng.integers(0, 3))]
        x = float(rng.normal())
        y = x + ("abc".index(level)) * 0.5 + float(rng.normal())
        data.append((level, "top" if level == "a" else "low", x, 3.0 * x - 1.0, y, "yes" if y > 0.5 else "no"))
    return spark.createDataFrame(data, "f string, nested string, x double, twice double, y double, z string")


FULL = [Factor("f", ("a", "b", "c")), Factor("nested", ("low", "top")), Numeric("x"), Numeric("twice")]
REDUCED = [Factor("f", ("a", "b", "c")), Numeric("x")]


@pytest.mark.parametrize("fit", [lambda d, t: fit_lm(d, "y", t), lambda d, t: fit_logit(d, "z", "yes", t)])
def test_equals_the_reduced_fit(spark, rows, fit):
    got, want = fit(rows, FULL), fit(rows, REDUCED)
    names = got.design.names
    gone = [names.index("nestedtop"), names.index("twice")]
    kept = [i for i in range(len(names)) if i not in gone]
    assert np.isnan(got.beta[gone]).all() and np.isnan(got.se[gone]).all()
    assert np.allclose(got.beta[kept], want.beta, atol=1e-8) and np.allclose(got.se[kept], want.se, atol=1e-8)
    table = {r.term: r for r in got.table(spark).collect()}
    assert table["twice"].estimate is None and table["twice"].p_value is None and table["x"].estimate is not None
    if hasattr(got, "df_resid"):
        assert got.df_resid == want.df_resid and abs(got.rss - want.rss) < 1e-8
        a = got.predict(rows).agg(F.sum("fit")).first()[0]
        assert abs(a - want.predict(rows).agg(F.sum("fit")).first()[0]) < 1e-6
    else:
        assert abs(got.loglik - want.loglik) < 1e-8


def test_an_id_is_no_factor(spark):
    with pytest.raises(ValueError, match="levels"):
        build_design(spark.range(3000), [Factor("id")])
