"""DuckDB SQL of the queries whose results SQL can state, written from their definitions."""

from __future__ import annotations

import string

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase

#: Components of links(a, b) over the rows of a table: {name}(rid, component) with the smallest id reached.
_REACH = """
{name}_r(rid, c) AS (SELECT rid, {id} FROM {rows} UNION SELECT l.b, r.c FROM {name}_r r JOIN {links} l ON l.a = r.rid),
{name} AS (SELECT rid, min(c) AS component FROM {name}_r GROUP BY rid)"""

SHINGLE_JOIN = f"""WITH RECURSIVE
w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[k:k + 4] END, ' ') AS sh
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0) q),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
{_REACH.format(name="c", id="doc_id", rows="w", links="links").strip()}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component AS component_id FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)"""

VECTOR_JOIN = f"""WITH RECURSIVE
e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
u AS MATERIALIZED (SELECT rid, label, len(embedding) AS m, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS i
  FROM e WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS MATERIALIZED (SELECT rid, sqrt(sum(x * x)) AS norm FROM u GROUP BY rid
  HAVING bool_and(coalesce(isfinite(x), FALSE)) AND sum(x * x) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM u a JOIN g ga ON ga.rid = a.rid JOIN u b ON b.label = a.label AND b.m = a.m
  AND b.i = a.i AND b.rid <> a.rid JOIN g gb ON gb.rid = b.rid GROUP BY a.rid, b.rid
  HAVING sum(a.x * b.x) / (any_value(ga.norm) * any_value(gb.norm)) >= 0.98),
{_REACH.format(name="c", id="vec_id", rows="e", links="links").strip()},
k AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component AS component_id, e.vec_id = c.component AS kept
FROM e JOIN c USING (rid) LEFT JOIN k USING (rid)"""

CHAT_FORMAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS given, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]') q),
f AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS>>|ROLE>>|ROLE:))', '\1\\\2\3', 'g')) + 1 + CASE role
  WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('<s></s>') WHEN 'system' THEN length('<<SYS>><</SYS>>')
  ELSE length('<<ROLE:>><</ROLE>>') + length(url_encode(role)) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, given, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, given, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def url_filter(rules, threshold: float = 1.0, rounds: int = 180) -> str:
    """The url query for the given rules; after 180 rounds less than 1e-12 of the mass moves."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def case(value) -> str:
        arms = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{value(r)}'"
                        for r in ordered)
        return f"CASE {arms} END"

    links = r"""(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''<>\s]+)"""
    lower = f"translate({{0}}, '{_UP}', '{_LOW}')"
    ranks = ["r0 AS MATERIALIZED (SELECT * FROM seeds)"]
    for k in range(1, rounds + 1):
        ranks.append(
            f"r{k} AS MATERIALIZED (SELECT kind, node, sum(mass) AS mass FROM (SELECT kind, node, (1 - 0.85E0) * mass AS mass FROM seeds "
            f"UNION ALL SELECT r.kind, s.dst, 0.85E0 * r.mass * s.p FROM r{k - 1} r JOIN steps s ON s.kind = r.kind AND s.src = r.node) q "
            f"GROUP BY kind, node)")
    return f"""WITH
a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host FROM a),
d AS (SELECT *, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
p AS MATERIALIZED (SELECT page_id, html, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM d),
h AS MATERIALIZED (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS allow,
  CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS block FROM p WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host AS node, allow / (SELECT sum(allow) FROM h) AS mass FROM h WHERE allow > 0
  UNION ALL SELECT 'distrust', host, block / (SELECT sum(block) FROM h) FROM h WHERE block > 0),
found AS (SELECT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + links + "', 1))")} AS dst FROM p),
site AS (SELECT host AS x, array_to_string(string_split(host, '.')[2:], '.') AS y FROM h WHERE len(string_split(host, '.')) > 2),
edges AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src, dst, 1 AS w FROM found WHERE src <> '' AND src <> dst
  UNION ALL SELECT x, y, 1 FROM site UNION ALL SELECT y, x, 1 FROM site) q GROUP BY src, dst),
steps AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS p FROM (SELECT 'trust' AS kind, src, dst, w FROM edges
  UNION ALL SELECT 'distrust', dst, src, w FROM edges) q),
{(',' + chr(10)).join(ranks)},
last AS (SELECT kind, node, mass / sum(mass) OVER (PARTITION BY kind) AS mass FROM r{rounds}),
s AS (SELECT h.host, round(coalesce(t.mass, 0) / (h.n / (SELECT sum(n) FROM h)), 9) AS trust,
  round(coalesce(x.mass, 0) / (h.n / (SELECT sum(n) FROM h)), 9) AS distrust FROM h
  LEFT JOIN last t ON t.kind = 'trust' AND t.node = h.host LEFT JOIN last x ON x.kind = 'distrust' AND x.node = h.host)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN distrust > {threshold!r} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  trust, distrust FROM p LEFT JOIN s ON s.host = p.host"""

COLLOCATIONS = f"""WITH
q AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM q),
t AS MATERIALIZED (SELECT lang, ws[k:k + m - 1] AS p, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS m) ms) o GROUP BY lang, p),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM t WHERE len(p) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM t WHERE len(p) > 1 AND f >= 100),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM c),
scores AS (SELECT cuts.lang, cuts.p, cuts.f AS a, k, x.f AS l, y.f AS r, n.n,
  (1000::HUGEINT * cuts.f * n.n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN n USING (lang)
  JOIN t x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN t y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, f, m, p[k:k + m - 1] AS s FROM (
  SELECT lang, f, p, m, unnest(range(1, len(p) - m + 2)) AS k FROM c JOIN (SELECT unnest(range(2, 5)) AS m) ms ON m < len(p)) o),
longer AS (SELECT lang, s, max(f) AS f FROM inside GROUP BY lang, s),
kept AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, CAST(b.score AS BIGINT) AS score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.s = b.p WHERE g.f IS NULL OR 100 * g.f < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000"""
