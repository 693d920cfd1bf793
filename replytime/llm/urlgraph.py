r"""URL verdicts from path rules and trust propagated over host edges.

Rules decide first: the longest rule (host, path) that fits wins.  All other
URLs get the verdict of their host, from two personalised PageRanks over the
host graph, computed with joins and sums only:

* trust starts at the pages allowed by a rule and follows the links;
* distrust starts at the pages blocked by a rule and follows them reversed
  (who links to a blocked host is suspect).

Edges are the links between different hosts in the pages' html (absolute
``href`` and ``src``), and a pair of edges between a host and the host without
its first label (one site).  A host's scores are divided by its share of all
pages; it is blocked when its distrust is above ``threshold`` and above its
trust.  Scores are rounded to 9 digits before they are compared, so the order
of floating sums does not matter.

Edge cases: a null url, or one without ``://``, has an empty host and path; no
rule fits it.  A host that neither rank reaches is allowed.  A null html has
no links.  Repeated pages count once each.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

LINKS = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the url's path starts with path."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest ends up outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def parsed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return split.select("*", name.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, w: numbers of links between hosts, and the edges inside a site."""
    host, _ = host_and_path(F.col("url"))
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), 1)).alias("to"))
    links = found.select("src", lower_ascii(F.col("to")).alias("dst")).where(
        (F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w"))
    labels = F.split("host", r"\.")
    site = hosts.where(F.size(labels) > 2).select(
        F.col("host").alias("a"), F.array_join(F.slice(labels, 2, 1 << 20), ".").alias("b"))
    inside = site.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(
        site.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("w", F.lit(1).cast("long"))
    return links.unionByName(inside).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _steps(edges: DataFrame) -> DataFrame:
    """kind, src, dst, p: where a unit of trust (forward) or distrust (reversed) at src goes."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionAll(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = both.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("p"))


FOLLOW = 0.85
#: Edges that a task of a round follows, about.
STEPS_A_TASK = 200_000
#: Mass that may still move when the propagation stops.
TOLERANCE = 1e-12


def rounds_for(tolerance: float = TOLERANCE, follow: float = FOLLOW) -> int:
    """Rounds after which at most `tolerance` of the mass moves.

    A round passes on at most the share `follow` of what moved in the round before, whatever the graph, so
    the bound holds without measuring it.
    """
    return math.ceil(math.log(tolerance) / math.log(follow))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, follow: float = FOLLOW,
              cut_every: int = 10) -> DataFrame:
    """kind, node, mass: personalised PageRank from seeds (kind, node, mass), both kinds at once, to convergence.

    `rounds` is for tests of the single steps.
    """
    rounds = rounds_for(TOLERANCE, follow) if rounds is None else rounds
    # a round is small next to the pages: its tasks are sized by the measured edges, not by the session's partitions
    steps = stored(_steps(edges))
    tasks = 1 + steps.count() // STEPS_A_TASK
    back = seeds.select("kind", "node", ((1 - follow) * F.col("mass")).alias("mass"))
    rank = seeds
    for k in range(1, rounds + 1):
        sent = steps.join(rank.withColumnRenamed("node", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("node"), (follow * F.col("mass") * F.col("p")).alias("mass"))
        rank = back.unionByName(sent).groupBy("kind", "node").agg(F.sum("mass").alias("mass")).coalesce(tasks)
        if k % cut_every == 0 or k == rounds:
            rank = cut(rank)
    return rank


def host_scores(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, trust, distrust: ranks divided by the host's share of all pages."""
    counted = cut(parsed(pages, rules).groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("block")).where(F.col("host") != ""))
    n, allow, block = counted.agg(F.sum("n"), F.sum("allow"), F.sum("block")).first()
    seeds = counted.select(F.lit("trust").alias("kind"), F.col("host").alias("node"),
                           (F.col("allow") / F.lit(float(allow or 1))).alias("mass")).unionAll(
        counted.select(F.lit("distrust").alias("kind"), F.col("host").alias("node"),
                       (F.col("block") / F.lit(float(block or 1))).alias("mass"))).where(F.col("mass") > 0)
    rank = propagate(cut(seeds.coalesce(1 + counted.count() // STEPS_A_TASK)), host_edges(pages, counted))
    # what leaves at hosts without edges would start again at the seeds: the same as one common factor
    mass = {r["kind"]: r["m"] for r in rank.groupBy("kind").agg(F.sum("mass").alias("m")).collect()}
    wide = rank.groupBy(F.col("node").alias("host")).agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass") / (mass.get("trust") or 1.0))).alias("t"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass") / (mass.get("distrust") or 1.0))).alias("d"))
    share = F.col("n") / F.lit(float(n or 1))
    return counted.join(wide, "host", "left").select(
        "host", *[F.round(F.coalesce(F.col(c), F.lit(0.0)) / share, 9).alias(name)
                  for c, name in (("t", "trust"), ("d", "distrust"))])


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    scores = stored(host_scores(pages, rules))
    blocked = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    return parsed(pages, rules).join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
