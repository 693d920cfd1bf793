"""URL rules by hand, propagation against matrix products."""

import numpy as np
import pytest

from replytime.llm import urlgraph
from replytime.llm.queries import RULES, op4_url_filter

from ..conftest import SF0001


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
        ("https://example.net/en", "example.net", "/en", "net/"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/"),
        ("http://net/x", "net", "/x", "net/"),
        ("http://x.net", "x.net", "", None),
        ("http://x.net?q=http://y.com/de/", "x.net", "", None),
        ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/"),
        ("http://www.example.com/DE/1", "www.example.com", "/DE/1", None),
        ("ftp://a.org/fr/", "a.org", "/fr/", "org/fr/"),
        ("http://a.org#/fr/", "a.org", "", None),
        ("ÄÖ://É.ORG/fr/b://c", "É.org", "/fr/b://c", "org/fr/"),
        ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None), ("://", "", "", None),
    ]
    df = pages(spark, [(k, c[0], None, "clash") for k, c in enumerate(cases)])
    out = {r["page_id"]: r for r in urlgraph.judge(df, RULES).collect()}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host, path, rule), cases[k]
        if rule:
            assert out[k]["verdict"] == next(r.verdict for r in RULES if r.name == rule)
        else:
            assert out[k]["verdict"] in ("allow", "block")


def test_propagation_equals_matrix_products(spark):
    rng = np.random.default_rng(4)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.4)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", int(w[a, b])) for a in range(n) for b in range(n) if w[a, b]],
                                  "src string, dst string, w long")
    seeds = spark.createDataFrame([("trust", "h0", 0.5), ("trust", "h1", 0.5), ("distrust", "h2", 1.0)],
                                  "kind string, node string, mass double")
    got = {(r["kind"], r["node"]): r["mass"] for r in urlgraph.propagate(seeds, edges, rounds=7, cut_every=3).collect()}
    for kind, m, start in (("trust", w, {0: 0.5, 1: 0.5}), ("distrust", w.T, {2: 1.0})):
        p = m / np.maximum(1, m.sum(axis=1, keepdims=True))
        seed = np.zeros(n)
        for k, v in start.items():
            seed[k] = v
        rank = seed
        for _ in range(7):
            rank = 0.15 * seed + 0.85 * rank @ p
        for k in range(n):
            assert got.get((kind, f"h{k}"), 0.0) == pytest.approx(rank[k], abs=1e-12)


def test_links_carry_distrust_and_trust(spark):
    bad = '<a href="http://bad.net/x">a</a> <a HREF=\'//bad.net/y\'>b</a> <img src=http://bad.net/z.png>'
    good = '<a href="https://friend.info/p">x</a>'
    rows = [(1, "http://bad.net/x", None, ""), (2, "http://farm.info/a", bad, ""), (2, "http://farm.info/a", bad, ""),
            (3, "http://fine.org/fr/a", good, ""), (4, "http://friend.info/q", None, ""),
            (5, "http://lone.info/q", "<a href='/local'>x</a>", "")]
    out = {r["page_id"]: r for r in urlgraph.judge(pages(spark, rows), RULES).collect()}
    assert out[2]["verdict"] == "block" and out[2]["distrust"] > 1 > out[2]["trust"]
    assert out[4]["verdict"] == "allow" and out[4]["trust"] > 0
    assert out[5]["verdict"] == "allow" and out[5]["trust"] == out[5]["distrust"] == 0


def test_empty_table_and_query(spark):
    assert urlgraph.judge(pages(spark, [(1, None, None, None)]).limit(0), RULES).count() == 0
    n = spark.read.parquet(f"{SF0001}/pages.parquet").count()
    df = op4_url_filter(spark, SF0001)
    assert df.count() == n and {r[0] for r in df.select("verdict").distinct().collect()} <= {"allow", "block"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_chain_of_hosts_converges(spark):
    """Mass at the end of a chain of 30 hosts: 0.15 * 0.85 ** k, and all of the rest at the last host."""
    edges = spark.createDataFrame([(f"h{k:02}", f"h{k + 1:02}", 1) for k in range(29)], "src string, dst string, w long")
    seeds = spark.createDataFrame([("trust", "h00", 1.0)], "kind string, node string, mass double")
    got = {r["node"]: r["mass"] for r in urlgraph.propagate(seeds, edges).collect()}
    assert 0.85 ** urlgraph.rounds_for() <= 1e-12
    for k in range(30):
        assert got[f"h{k:02}"] == pytest.approx(0.15 * 0.85 ** k, abs=1e-12)
