"""Sources, joins and aggregates on small inputs."""

import pytest
from pyspark.sql import functions as F

from replytime import levels as L
from replytime.operators import describe as D
from replytime.operators import filters as FL
from replytime.operators import joins as J
from replytime.operators import stattests as ST
from replytime.sources import scan

from .conftest import SF0001


def test_wave_union_renames_and_aligns(spark):
    from replytime.sources.fixture import inpatient
    base = inpatient(spark, SF0001)
    w06 = scan.as_wave(base, 2006)
    assert "mailing_one" in w06.columns and "q66" in w06.columns and "mailing1" not in w06.columns
    u = scan.wave_union({2006: w06, 2009: scan.as_wave(base, 2009)})
    assert u.columns == [f.name for f in scan.SURVEY_SCHEMA.fields]
    counts = {r.wave: r["count"] for r in u.groupBy("wave").count().collect()}
    n = base.count()
    assert counts == {2006: n, 2009: n}
    # the renamed rating lands in the canonical column
    assert u.where((F.col("wave") == 2006) & F.col("q74").isNotNull()).count() == base.where(
        F.col("q74").isNotNull()).count()


def test_csv_roundtrip_keeps_labels_and_types(spark):
    rows = [("I never got help when I used the call button ", 1, 2.5), (None, None, None)]
    df = spark.createDataFrame(rows, "q49 string, n int, x double")
    back = scan.csv_roundtrip(spark, df)
    assert back.schema == df.schema
    assert sorted(back.collect(), key=lambda r: r.n or 0) == sorted(df.collect(), key=lambda r: r.n or 0)


def test_exclude_trusts_by_code(spark):
    df = spark.createDataFrame([("T1", 1), ("T2", 2), ("T3", 3), (None, 4)], "trustcode string, record int")
    kept = sorted(r.record for r in FL.exclude_trusts(df, spark, ["T2", "T9"]).collect())
    assert kept == [1, 3, 4]


def test_bind_imputed_checks_counts(spark):
    a = spark.createDataFrame([("T1", 1, "x"), ("T1", 2, "y")], "trustcode string, record int, q1 string")
    b = spark.createDataFrame([("T1", 1, 5.0)], "trustcode string, record int, mailing1 double")
    for left, right in ((a, b), (b, a)):
        with pytest.raises(Exception, match="no partner for T1 2"):
            J.bind_imputed(left, right).collect()
    assert J.bind_imputed(a, a.withColumnRenamed("q1", "q2")).count() == 2


def test_level_codes_skip_unused(spark):
    df = spark.createDataFrame([("Excellent",), ("Fair",), ("Fair",), (None,)], "q74 string")
    dic = L.factor_levels(spark, waves=(2009,))
    got = {r.level: (r.n, r.code) for r in D.level_codes(df, dic, ["q74"]).collect()}
    assert got == {"Excellent": (1, 1), "Very good": (0, None), "Good": (0, None), "Fair": (2, 2),
                   "Poor": (0, None)}


def test_chi_square_matches_full_grid(spark):
    # 2 x 3 table with an empty cell: the observed-cells formula equals the textbook sum
    cells = {("a", "x"): 10, ("a", "y"): 0, ("a", "z"): 5, ("b", "x"): 4, ("b", "y"): 7, ("b", "z"): 9}
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = ST.chi_square_independence(df, "a", "b").first()
    n = sum(cells.values())
    ra = {k: sum(v for (a, _), v in cells.items() if a == k) for k in "ab"}
    cb = {k: sum(v for (_, b), v in cells.items() if b == k) for k in "xyz"}
    stat = sum((cells[(a, b)] - ra[a] * cb[b] / n) ** 2 / (ra[a] * cb[b] / n) for a in "ab" for b in "xyz")
    assert abs(out.statistic - stat) < 1e-9 and out.df == 2
    import math
    assert abs(out.p_value - math.exp(-stat / 2)) < 1e-12


def test_welch_and_anova_by_hand(spark):
    rows = [("g1", 1.0), ("g1", 2.0), ("g1", 4.0), ("g2", 2.0), ("g2", 6.0), ("g2", 7.0), ("g2", 9.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    t = ST.welch_t_test(df, "y", "g", ("g1", "g2")).first()
    import statistics as st
    a, b = [1.0, 2.0, 4.0], [2.0, 6.0, 7.0, 9.0]
    va, vb = st.variance(a) / 3, st.variance(b) / 4
    assert abs(t.t - (st.mean(a) - st.mean(b)) / (va + vb) ** 0.5) < 1e-12
    assert abs(t.df - (va + vb) ** 2 / (va ** 2 / 2 + vb ** 2 / 3)) < 1e-9
    assert 0 < t.p_value < 1
    f = ST.one_way_anova(df, "y", "g").first()
    grand = st.mean(a + b)
    ssb = 3 * (st.mean(a) - grand) ** 2 + 4 * (st.mean(b) - grand) ** 2
    ssw = sum((x - st.mean(a)) ** 2 for x in a) + sum((x - st.mean(b)) ** 2 for x in b)
    assert abs(f.f - ssb / (ssw / 5)) < 1e-9 and f.df1 == 1 and f.df2 == 5
    # with two groups F equals the pooled t statistic squared; p-values agree
    from replytime.functions.distributions import t_sf2
    t_pooled = (st.mean(a) - st.mean(b)) / ((ssw / 5) * (1 / 3 + 1 / 4)) ** 0.5
    assert abs(f.f - t_pooled ** 2) < 1e-9
    assert abs(f.p_value - t_sf2(t_pooled, 5)) < 1e-12


def test_parquet_roundtrip_partition_pruning(spark):
    from replytime.operators.derive import derive_wave
    from replytime.sources.fixture import inpatient
    base = inpatient(spark, SF0001)
    u = scan.wave_union({w: scan.as_wave(base, w) for w in (2008, 2009)})
    d = derive_wave(u, censor_by=("wave",))
    back = scan.parquet_roundtrip(spark, d, partition_by=("wave",))
    assert back.count() == 2 * base.count()
    one = back.where(F.col("wave") == 2009).select("reply_time")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in plan and "= 2009" in plan
    assert one.count() == base.count()


def test_kde_without_groups_matches_numpy(spark):
    import numpy as np
    from replytime.operators.plotdata import kde_density
    xs = [1.0, 2.0, 2.0, 3.0, 7.0, 8.0, 8.0, 8.0, 13.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = sorted(kde_density(df, "x", n_grid=64).collect(), key=lambda r: r.j)
    a = np.array(xs)
    q75, q25 = np.percentile(a, [75, 25])
    bw = 0.9 * min(a.std(ddof=1), (q75 - q25) / 1.34) * len(a) ** -0.2
    grid = np.linspace(a.min() - 3 * bw, a.max() + 3 * bw, 64)
    dens = np.exp(-0.5 * ((grid[:, None] - a[None, :]) / bw) ** 2).sum(axis=1) / (len(a) * bw * np.sqrt(2 * np.pi))
    assert len(out) == 64
    assert abs(out[0].bw - bw) < 1e-12
    assert np.allclose([r.x for r in out], grid, atol=1e-9)
    assert np.allclose([r.density for r in out], dens, atol=1e-12)


def test_chi_square_single_level_has_null_p_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "a string, b string")
    out = ST.chi_square_independence(df, "a", "b").first()
    assert out.df == 0 and out.p_value is None


def test_degenerate_groups_give_null_not_errors(spark):
    one = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g2", 5.0)], "g string, y double")
    t = ST.welch_t_test(one, "y", "g", ("g1", "g2")).first()
    assert t.t is None and t.p_value is None
    single = spark.createDataFrame([("g1", 1.0), ("g1", 2.0)], "g string, y double")
    f = ST.one_way_anova(single, "y", "g").first()
    assert f.df1 == 0 and f.f is None and f.p_value is None


def test_missing_by_column_on_empty_input(spark):
    empty = spark.createDataFrame([], "a string, b double")
    rows = {r.variable: (r.nas, r.n, r.prop_na) for r in D.missing_by_column(empty, ["a", "b"]).collect()}
    assert rows == {"a": (0, 0, None), "b": (0, 0, None)}


def test_approximate_quartiles_close_to_exact(spark):
    import numpy as np
    from replytime.operators.plotdata import boxplot_stats, kde_density
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(10, 3, 3000))]
    df = spark.createDataFrame(rows, "g string, y double")
    ex = {r.g: r for r in boxplot_stats(df, "y", "g").collect()}
    ap = {r.g: r for r in boxplot_stats(df, "y", "g", exact=False).collect()}
    for g in ex:
        assert abs(ex[g].middle - ap[g].middle) < 0.05 and ex[g].n == ap[g].n
    k_ex = kde_density(df, "y", by=("g",)).where("j = 256").collect()
    k_ap = kde_density(df, "y", by=("g",), exact=False).where("j = 256").collect()
    assert len(k_ex) == len(k_ap) == 2
    for a, b in zip(sorted(k_ex), sorted(k_ap)):
        assert abs(a.bw - b.bw) / a.bw < 0.01


def test_waves_are_censored_by_their_own_last_date(spark):
    """Censoring every wave at the last date of all gives other times: the per-wave queries would not match."""
    from replytime.operators.derive import derive_wave
    from replytime.plans.common import WAVES, all_waves
    u = all_waves(spark, SF0001)
    last = {r["wave"]: r["m"] for r in u.groupBy("wave").agg(F.max("daterec").alias("m")).collect()}
    assert sorted(last) == list(WAVES) and len(set(last.values())) == 4
    own = derive_wave(u, censor_by=("wave",)).where("wave = 2006 and event = 0").agg(F.max("reply_time")).first()[0]
    joint = derive_wave(u).where("wave = 2006 and event = 0").agg(F.max("reply_time")).first()[0]
    assert own < 200 and joint > 1000


def test_facts_read_once_give_the_same_table_with_one_scan(spark):
    from replytime.operators.derive import censor_facts, derive_wave
    from replytime.sources.fixture import inpatient
    r = inpatient(spark, SF0001)
    a, b = derive_wave(r), derive_wave(r, facts=censor_facts(r))
    assert a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    b.write.format("noop").mode("overwrite").save()
    assert b._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    none = r.where("daterec is null and q74 is null")
    assert censor_facts(none) == (None, ()) and derive_wave(none, facts=censor_facts(none)).count() == none.count()
