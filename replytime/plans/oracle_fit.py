"""SQL texts that fit the models themselves, for DuckDB.

The fits are Newton steps in plain SQL: per step one grouped sum gives the
information matrix and the score as (i, j, v) entries, a recursive Gauss-Jordan
elimination solves the system, and the next step starts from the result.  They
share nothing with the DataFrame fits but the model's definition.  Answer
levels and the stand-in wave's rules come from the library's constants.

A *design* is a list of (term name, SQL expression, column that must be
present).  All texts extend ``oracle_base.DERIVED_SQL``, whose last table is d.
"""

from __future__ import annotations

from .oracle_base import DERIVED_SQL

ONE = ("(Intercept)", "1.0E0", None)


def flag(col: str, level: str, name: str | None = None) -> tuple:
    """Treatment-coded indicator."""
    return (name or col) + level, f"CASE WHEN {col} = '{level}' THEN 1.0E0 ELSE 0.0E0 END", col


TRI = [flag("overall_tri", "Other"), flag("overall_tri", "Very good")]
EMERG = [flag("emergency", "yes")]
AGE = [flag("age_group", v) for v in ("36-50", "51-65", "66+")]
LOGLOS = [("log_los", "CAST(log_los AS DOUBLE)", "log_los")]
GENDER = [flag("gender", "Male")]
CHOICE = [flag("choice", "Yes")]
STRATA = [flag("reply_strata", "Mail2"), flag("reply_strata", "Mail3")]
TIME = [("reply_time", "CAST(reply_time AS DOUBLE)", "reply_time")]
COVARS = [*EMERG, *AGE, *LOGLOS, *GENDER]
FULL = [*TRI, *COVARS]


def with_fit(body: str, ctes: list[str], source: str = "") -> str:
    """The whole text: derived table, the given CTEs, the final select."""
    return f"WITH RECURSIVE {DERIVED_SQL}{source}, " + ",\n".join(ctes) + f"\n{body}"


def patterns(pre: str, design: list, keep: dict[str, str], where: str = "TRUE", source: str = "d") -> list[str]:
    """{pre}_s: distinct rows (rid, w, keep...) and {pre}_x: their design (rid, i, x)."""
    present = " AND ".join([where, *[f"{c} IS NOT NULL" for c in dict.fromkeys(c for _, _, c in design if c)],
                            *[f"({e}) IS NOT NULL" for e in keep.values()]])
    xs = ", ".join(e for _, e, _ in design)
    kept = "".join(f", {e} AS {k}" for k, e in keep.items())
    names = "".join(f", {k}" for k in keep)
    return [
        f"{pre}_r AS MATERIALIZED (SELECT [{xs}] AS xs{kept} FROM {source} WHERE {present})",
        f"{pre}_s AS MATERIALIZED (SELECT row_number() OVER () AS rid, xs, CAST(count(*) AS DOUBLE) AS w{names} "
        f"FROM {pre}_r GROUP BY xs{names})",
        f"{pre}_x AS MATERIALIZED (SELECT rid, unnest(range(1, {len(design) + 1})) AS i, unnest(xs) AS x FROM {pre}_s)",
    ]


def solved(name: str, entries: str, p: int) -> list[str]:
    """{name}(i, j, v): the entries (i, j, v) with i <= p after elimination of columns 1..p."""
    return [
        f"{name}_m AS MATERIALIZED ({entries})",
        f"""{name}_g(k, i, j, v) AS (
  SELECT 0, i, j, v FROM {name}_m UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN kj / kk ELSE v - ik * kj / kk END FROM (
    SELECT *, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY j) AS kj,
           max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY i) AS ik,
           max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER () AS kk FROM {name}_g WHERE k < {p}) z)""",
        f"{name} AS MATERIALIZED (SELECT i, j, v FROM {name}_g WHERE k = {p})",
    ]


def newton(pre: str, p: int, start: str, sums, steps: int, most: float = 1e9) -> list[str]:
    """Steps {pre}_b0 ... of (i, b); the last is {pre}_b, and {pre}_v has its covariance (i, j, v).

    sums(t, beta) returns CTEs and the entries' text (i, j, v): the information,
    with the score in column p + 1.  A step changes no parameter by more than most.
    """
    out = [f"{pre}_b0 AS MATERIALIZED ({start})"]
    for t in range(1, steps + 1):
        ctes, entries = sums(t, f"{pre}_b{t - 1}")
        out += ctes + solved(f"{pre}_n{t}", entries, p)
        out.append(f"{pre}_b{t} AS MATERIALIZED (SELECT b.i, b.b + greatest(-{most}, least({most}, n.v)) AS b FROM {pre}_b{t - 1} b "
                   f"JOIN {pre}_n{t} n ON n.i = b.i AND n.j = {p + 1})")
    ctes, entries = sums(steps + 1, f"{pre}_b{steps}")
    unit = (f"SELECT i, j, v FROM ({entries}) q WHERE j <= {p} UNION ALL SELECT a.i, {p} + b.i, CASE WHEN a.i = b.i "
            f"THEN 1.0E0 ELSE 0.0E0 END FROM {pre}_b{steps} a, {pre}_b{steps} b")
    out += ctes + solved(f"{pre}_c", unit, p)
    out += [f"{pre}_b AS MATERIALIZED (SELECT * FROM {pre}_b{steps})",
            f"{pre}_v AS MATERIALIZED (SELECT i, j - {p} AS j, v FROM {pre}_c WHERE j > {p})"]
    return out


def zeros(p: int) -> str:
    return f"SELECT unnest(range(1, {p + 1})) AS i, 0.0E0 AS b"


def names(pre: str, terms: list[str]) -> str:
    """{pre}_t(i, term)."""
    quoted = ", ".join(f"({k}, '{t}')" for k, t in enumerate(terms, 1))
    return f"{pre}_t AS (SELECT * FROM (VALUES {quoted}) t(i, term))"


def tails(name: str, source: str, df: str | None = None) -> str:
    """{name}: the rows of source with p, the area of both tails beyond its column z (normal, or t with df)."""
    if df is None:
        density, end = "exp(-u * u / 2.0E0) / sqrt(2.0E0 * pi())", 12
    else:
        density = (f"exp(lgamma(({df} + 1) / 2.0E0) - lgamma({df} / 2.0E0)) / sqrt({df} * pi()) "
                   f"* pow(1.0E0 + u * u / {df}, -({df} + 1) / 2.0E0)")
        end = 40
    # Simpson's rule from 0 to |z|
    return (f"{name} AS MATERIALIZED (SELECT y.*, greatest(0.0E0, 1.0E0 - 2.0E0 * q.area) AS p FROM {source} y JOIN (SELECT i, "
            f"sum(c * ({density})) * any_value(h) / 3.0E0 AS area FROM (SELECT i, h, h * s AS u, CASE WHEN s = 0 OR s = 4000 THEN 1 "
            f"WHEN s % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT i, least(abs(z), {end}) / 4000.0E0 AS h, "
            f"unnest(range(0, 4001)) AS s FROM {source}) a) w GROUP BY i) q USING (i))")


def estimates(pre: str, terms: list[str], scale: str = "1.0E0", df: str | None = None, var: str = "v") -> list[str]:
    """{pre}_e(i, term, b, se, z, p): standard errors from {pre}_{var} times scale; normal or t tail areas."""
    return [
        names(pre, terms),
        f"{pre}_y AS MATERIALIZED (SELECT t.i, t.term, b.b, sqrt(v.v * {scale}) AS se, b.b / sqrt(v.v * {scale}) AS z "
        f"FROM {pre}_t t JOIN {pre}_b b ON b.i = t.i JOIN {pre}_{var} v ON v.i = t.i AND v.j = t.i)",
        tails(f"{pre}_e", f"{pre}_y", df),
    ]


def terms_of(design: list, *more: str) -> list[str]:
    return [n for n, _, _ in design] + list(more)


def linear(pre: str, design: list) -> str:
    """x'b of a row as SQL."""
    return " + ".join(f"(SELECT b FROM {pre}_b WHERE i = {k}) * {e}" for k, (_, e, _) in enumerate(design, 1))


def present(design: list) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys(c for _, _, c in design if c))


TIDY = ("SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(z, 4) AS statistic, "
        "round(p, 6) AS p_value FROM {pre}_e")


def tidy(pre: str) -> str:
    return TIDY.format(pre=pre)


def ols(pre: str, design: list, y: str, where: str = "TRUE", source: str = "d") -> list[str]:
    """Least squares; {pre}_q(n, s2) has the rows and the residual variance."""
    p = len(design)

    def sums(t, beta):
        return [f"{pre}_f{t} AS MATERIALIZED (SELECT x.rid, sum(x.x * b.b) AS f FROM {pre}_x x JOIN {beta} b USING (i) "
                f"GROUP BY x.rid)"], (
            f"SELECT a.i, b.i AS j, sum(s.w * a.x * b.x) AS v FROM {pre}_x a JOIN {pre}_x b USING (rid) "
            f"JOIN {pre}_s s USING (rid) GROUP BY a.i, b.i UNION ALL SELECT a.i, {p + 1}, sum(s.w * a.x * (s.y - f.f)) "
            f"FROM {pre}_x a JOIN {pre}_s s USING (rid) JOIN {pre}_f{t} f USING (rid) GROUP BY a.i")

    last = 3
    return [*patterns(pre, design, {"y": y}, where, source), *newton(pre, p, zeros(p), sums, last - 1),
            f"{pre}_q AS MATERIALIZED (SELECT sum(s.w) AS n, sum(s.w * (s.y - f.f) * (s.y - f.f)) / (sum(s.w) - {p}) AS s2 "
            f"FROM {pre}_s s JOIN {pre}_f{last} f USING (rid))"]


def logit(pre: str, design: list, y: str, success: str, where: str = "TRUE", source: str = "d", steps: int = 8) -> list[str]:
    """Logistic regression."""
    p = len(design)

    def sums(t, beta):
        return [f"{pre}_f{t} AS MATERIALIZED (SELECT x.rid, 1.0E0 / (1.0E0 + exp(-sum(x.x * b.b))) AS mu FROM {pre}_x x "
                f"JOIN {beta} b USING (i) GROUP BY x.rid)"], (
            f"SELECT a.i, b.i AS j, sum(s.w * f.mu * (1 - f.mu) * a.x * b.x) AS v FROM {pre}_x a JOIN {pre}_x b USING (rid) "
            f"JOIN {pre}_s s USING (rid) JOIN {pre}_f{t} f USING (rid) GROUP BY a.i, b.i UNION ALL "
            f"SELECT a.i, {p + 1}, sum(s.w * a.x * (s.y - f.mu)) FROM {pre}_x a JOIN {pre}_s s USING (rid) "
            f"JOIN {pre}_f{t} f USING (rid) GROUP BY a.i")

    keep = {"y": f"CASE WHEN {y} = '{success}' THEN 1.0E0 WHEN {y} IS NOT NULL THEN 0.0E0 END"}
    return [*patterns(pre, design, keep, where, source), *newton(pre, p, zeros(p), sums, steps)]


def aft(pre: str, design: list, time: str = "reply_time", dist: str = "loglogistic", where: str = "TRUE",
        source: str = "d", steps: int = 18, cluster: str | None = None) -> list[str]:
    """Accelerated failure time model; the last parameter is log(scale).

    With x_j / scale as design and z as the design of log(scale), the score is
    -dl x (less the number of events for the last), and the information
    -(d2l x x' + dl (the other's x) in the last row and column).
    """
    p = len(design)
    if dist == "loglogistic":
        dl = "CASE WHEN event = 1 THEN 1 - 2 * pz ELSE -pz END"
        d2l = "CASE WHEN event = 1 THEN -2 * pz * (1 - pz) ELSE -pz * (1 - pz) END"
        pz = "1.0E0 / (1.0E0 + exp(-z))"
    else:
        dl, d2l, pz = "CASE WHEN event = 1 THEN 1 - pz ELSE -pz END", "-pz", "exp(z)"

    def sums(t, beta):
        f, x = f"{pre}_f{t}", f"{pre}_u{t}"
        return [
            f"{f} AS MATERIALIZED (SELECT *, {dl} AS dl, {d2l} AS d2l FROM (SELECT *, {pz} AS pz FROM (SELECT s.rid, s.w, "
            f"s.event, (s.logt - e.eta) / exp(k.b) AS z, exp(k.b) AS sigma FROM {pre}_s s JOIN (SELECT x.rid, sum(x.x * b.b) "
            f"AS eta FROM {pre}_x x JOIN {beta} b USING (i) GROUP BY x.rid) e USING (rid), (SELECT b FROM {beta} "
            f"WHERE i = {p + 1}) k) a) b)",
            f"{x} AS MATERIALIZED (SELECT x.rid, x.i, x.x / f.sigma AS x FROM {pre}_x x JOIN {f} f USING (rid) UNION ALL "
            f"SELECT rid, {p + 1}, z FROM {f})"], (
            f"SELECT a.i, b.i AS j, -sum(f.w * (f.d2l * a.x * b.x + f.dl * CASE WHEN b.i = {p + 1} THEN a.x WHEN a.i = {p + 1} "
            f"THEN b.x ELSE 0.0E0 END)) AS v FROM {x} a JOIN {x} b USING (rid) JOIN {f} f USING (rid) GROUP BY a.i, b.i UNION ALL "
            f"SELECT a.i, {p + 2}, sum(f.w * (-f.dl * a.x - CASE WHEN a.i = {p + 1} AND f.event = 1 THEN 1.0E0 ELSE 0.0E0 END)) "
            f"FROM {x} a JOIN {f} f USING (rid) GROUP BY a.i")

    keep = {"logt": f"CASE WHEN {time} > 0 THEN ln(CAST({time} AS DOUBLE)) END", "event": "event"}
    if cluster:
        keep["cl"] = cluster
    # the exponential model without covariates (total time by events), or the mean log time of the events
    first = ("ln(sum(w * exp(logt)) / sum(w * event))" if dist == "weibull" or p == 1
             else "sum(w * event * logt) / sum(w * event)")
    # the scale whose logistic has the spread of the events' log times
    spread = ("max(0.0E0)" if dist == "weibull" or p == 1 else "ln(0.55E0 * sqrt(sum(w * event * logt * logt) / sum(w * event) "
              "- (sum(w * event * logt) / sum(w * event)) * (sum(w * event * logt) / sum(w * event))))")
    start = (f"SELECT i, CASE WHEN i = 1 THEN (SELECT {first} FROM {pre}_s) WHEN i = {p + 1} THEN (SELECT {spread} FROM {pre}_s) "
             f"ELSE 0.0E0 END AS b FROM (SELECT unnest(range(1, {p + 2})) AS i) z")
    out = [*patterns(pre, design, keep, where, source), *newton(pre, p + 1, start, sums, steps, 0.5)]
    if cluster:
        f, x = f"{pre}_f{steps + 1}", f"{pre}_u{steps + 1}"
        out += [
            f"{pre}_k AS MATERIALIZED (SELECT s.cl, a.i, sum(f.w * (-f.dl * a.x - CASE WHEN a.i = {p + 1} AND f.event = 1 "
            f"THEN 1.0E0 ELSE 0.0E0 END)) AS u FROM {x} a JOIN {f} f USING (rid) JOIN {pre}_s s USING (rid) GROUP BY s.cl, a.i)",
            f"{pre}_h AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.u * b.u) AS v FROM {pre}_k a JOIN {pre}_k b USING (cl) "
            f"GROUP BY a.i, b.i)",
            f"{pre}_w AS MATERIALIZED (SELECT a.i, c.j, sum(a.v * m.v * c.v) AS v FROM {pre}_v a JOIN {pre}_h m ON m.i = a.j "
            f"JOIN {pre}_v c ON c.i = m.j GROUP BY a.i, c.j)",
        ]
    return out


def cox(pre: str, design: list, time: str = "reply_time", where: str = "TRUE", steps: int = 8) -> list[str]:
    """Cox model with Efron ties; {pre}_z(time, d, i, s1, e1, A0 ...) is left at the last step."""
    p = len(design)

    def sums(t, beta):
        r, a, one, two, ef = (f"{pre}_{k}{t}" for k in ("f", "a", "o", "p", "q"))
        back = "OVER (PARTITION BY {0} ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return [
            f"{r} AS MATERIALIZED (SELECT s.rid, s.time, s.event, s.w, exp(e.eta) AS r FROM {pre}_s s JOIN (SELECT x.rid, "
            f"sum(x.x * b.b) AS eta FROM {pre}_x x JOIN {beta} b USING (i) GROUP BY x.rid) e USING (rid))",
            f"{a} AS MATERIALIZED (SELECT time, d, e0, sum(a0) OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND "
            f"CURRENT ROW) AS s0 FROM (SELECT time, sum(w * event) AS d, sum(w * event * r) AS e0, sum(w * r) AS a0 FROM {r} "
            f"GROUP BY time) z)",
            f"{ef} AS MATERIALIZED (SELECT time, any_value(d) AS d, sum(1 / den) AS A0, sum(u / den) AS A1, sum(1 / (den * den)) "
            f"AS B0, sum(u / (den * den)) AS B1, sum(u * u / (den * den)) AS B2 FROM (SELECT time, d, u, s0 - u * e0 AS den FROM "
            f"(SELECT *, unnest(range(0, CAST(d AS BIGINT))) / d AS u FROM {a} WHERE d > 0) y) z GROUP BY time)",
            f"{one} AS MATERIALIZED (SELECT time, i, sx, e1, sum(a1) {back.format('i')} AS s1 FROM (SELECT r.time, x.i, "
            f"sum(r.w * r.event * x.x) AS sx, sum(r.w * r.event * r.r * x.x) AS e1, sum(r.w * r.r * x.x) AS a1 FROM {r} r "
            f"JOIN {pre}_x x USING (rid) GROUP BY r.time, x.i) z)",
            f"{two} AS MATERIALIZED (SELECT time, i, j, e2, sum(a2) {back.format('i, j')} AS s2 FROM (SELECT r.time, x.i, y.i AS j, "
            f"sum(r.w * r.event * r.r * x.x * y.x) AS e2, sum(r.w * r.r * x.x * y.x) AS a2 FROM {r} r JOIN {pre}_x x USING (rid) "
            f"JOIN {pre}_x y USING (rid) GROUP BY r.time, x.i, y.i) z)"], (
            f"SELECT t.i, t.j, sum(t.s2 * q.A0 - t.e2 * q.A1 - (a.s1 * b.s1 * q.B0 - (a.s1 * b.e1 + a.e1 * b.s1) * q.B1 "
            f"+ a.e1 * b.e1 * q.B2)) AS v FROM {two} t JOIN {ef} q USING (time) JOIN {one} a ON a.time = t.time AND a.i = t.i "
            f"JOIN {one} b ON b.time = t.time AND b.i = t.j GROUP BY t.i, t.j UNION ALL SELECT a.i, {p + 1}, "
            f"sum(a.sx - (a.s1 * q.A0 - a.e1 * q.A1)) FROM {one} a JOIN {ef} q USING (time) GROUP BY a.i")

    keep = {"time": f"CAST({time} AS DOUBLE)", "event": "event"}
    last = steps + 1
    return [*patterns(pre, design, keep, where), *newton(pre, p, zeros(p), sums, steps),
            f"{pre}_z AS MATERIALIZED (SELECT o.time, o.i, o.s1, o.e1, q.d, q.A0, q.A1 FROM {pre}_o{last} o "
            f"JOIN {pre}_q{last} q USING (time))",
            f"{pre}_h AS MATERIALIZED (SELECT a.time, coalesce(q.A0, 0.0E0) AS dh FROM {pre}_a{last} a LEFT JOIN {pre}_q{last} q "
            f"USING (time))"]


def ordinal(pre: str, design: list, y: str, levels: list[str], where: str = "TRUE", source: str = "d",
            steps: int = 12) -> list[str]:
    """Proportional odds; parameters are the slopes, then the thresholds."""
    p, cuts = len(design), len(levels) - 1
    q = p + cuts
    number = " ".join(f"WHEN '{lv}' THEN {k}" for k, lv in enumerate(levels, 1))

    def sums(t, beta):
        f = f"{pre}_f{t}"
        return [f"{f} AS MATERIALIZED (SELECT *, CASE WHEN up IS NULL THEN 0 ELSE fa * (1 - fa) END / (fa - fb) AS ua, "
                f"CASE WHEN lo IS NULL THEN 0 ELSE fb * (1 - fb) END / (fa - fb) AS ub FROM (SELECT rid, w, k, up, lo, "
                f"CASE WHEN up IS NULL THEN 1.0E0 ELSE 1.0E0 / (1.0E0 + exp(e - up)) END AS fa, "
                f"CASE WHEN lo IS NULL THEN 0.0E0 ELSE 1.0E0 / (1.0E0 + exp(e - lo)) END AS fb FROM (SELECT s.rid, s.w, s.k, "
                f"h.b AS up, l.b AS lo, e.e FROM {pre}_s s JOIN (SELECT rid, sum(x * b) AS e FROM {pre}_x JOIN {beta} USING (i) "
                f"GROUP BY rid) e USING (rid) LEFT JOIN {beta} h ON h.i = {p} + s.k AND s.k <= {cuts} "
                f"LEFT JOIN {beta} l ON l.i = {p - 1} + s.k AND s.k > 1) y) z)"], (
            f"SELECT m.i, n.i AS j, -sum(f.w * ((f.ua * (1 - 2 * f.fa) - f.ua * f.ua) * m.a * n.a "
            f"- (f.ub * (1 - 2 * f.fb) + f.ub * f.ub) * m.b * n.b + f.ua * f.ub * (m.a * n.b + m.b * n.a))) AS v "
            f"FROM {pre}_ab m JOIN {pre}_ab n USING (rid) JOIN {f} f USING (rid) GROUP BY m.i, n.i UNION ALL "
            f"SELECT m.i, {q + 1}, sum(f.w * (f.ua * m.a - f.ub * m.b)) FROM {pre}_ab m JOIN {f} f USING (rid) GROUP BY m.i")

    start = (f"SELECT unnest(range(1, {p + 1})) AS i, 0.0E0 AS b UNION ALL SELECT {p} + c, ln(m / (n - m)) FROM (SELECT c, "
             f"sum(CASE WHEN k <= c THEN w ELSE 0 END) AS m, sum(w) AS n FROM {pre}_s, (SELECT unnest(range(1, {cuts + 1})) AS c) z "
             f"GROUP BY c) y")
    keep = {"k": f"CASE {y} {number} END"}
    return [*patterns(pre, design, keep, where, source),
            f"{pre}_ab AS MATERIALIZED (SELECT rid, i, -x AS a, -x AS b FROM {pre}_x UNION ALL SELECT rid, {p} + c, "
            f"CASE WHEN k = c THEN 1.0E0 ELSE 0.0E0 END, CASE WHEN k = c + 1 THEN 1.0E0 ELSE 0.0E0 END FROM {pre}_s, "
            f"(SELECT unnest(range(1, {cuts + 1})) AS c) z)",
            *newton(pre, q, start, sums, steps)]


def lmm_tri(pre: str, y: str, where: str = "TRUE") -> list[str]:
    """REML fit of y on satisfaction with a random intercept per trust: {pre}_e(i, term, b, se, z, p).

    With V = s2 (I + gamma 11') per trust all sums are closed forms of per-trust sums; the criterion is evaluated on
    a grid of log10(gamma), then on a finer one around the best, and the vertex of the last parabola is taken.
    """
    a = ["a11", "a12", "a13", "a22", "a23", "a33"]
    sums = ", ".join(f"sum({n} - w * {x} * {z}) AS {n}" for n, x, z in (
        ("a11", "n", "n"), ("a12", "n", "s2"), ("a13", "n", "s3"), ("a22", "s2", "s2"), ("a23", "s2", "s3"), ("a33", "s3", "s3")))
    det = ("a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)")
    inv = {"v11": "(a22 * a33 - a23 * a23)", "v12": "(a13 * a23 - a12 * a33)", "v13": "(a12 * a23 - a13 * a22)",
           "v22": "(a11 * a33 - a13 * a13)", "v23": "(a12 * a13 - a11 * a23)", "v33": "(a11 * a22 - a12 * a12)"}

    def at(name: str, grid: str) -> list[str]:
        return [
            f"{name}_0 AS MATERIALIZED (SELECT lg, {sums}, sum(sy - w * n * sy) AS b1, sum(y2 - w * s2 * sy) AS b2, "
            f"sum(y3 - w * s3 * sy) AS b3, sum(yy - w * sy * sy) AS c, sum(ln(1 + g * n)) AS ld, sum(n) AS nn FROM (SELECT k.*, lg, "
            f"pow(10.0E0, lg) AS g, pow(10.0E0, lg) / (1 + pow(10.0E0, lg) * k.n) AS w FROM {pre}_k k, ({grid}) q) z GROUP BY lg)",
            f"{name}_1 AS MATERIALIZED (SELECT *, {', '.join(f'{e} / det AS {n}' for n, e in inv.items())} FROM (SELECT *, {det} AS det "
            f"FROM {name}_0) z)",
            f"{name}_2 AS MATERIALIZED (SELECT *, v11 * b1 + v12 * b2 + v13 * b3 AS e1, v12 * b1 + v22 * b2 + v23 * b3 AS e2, "
            f"v13 * b1 + v23 * b2 + v33 * b3 AS e3 FROM {name}_1)",
            f"{name} AS MATERIALIZED (SELECT *, -0.5E0 * ((nn - 3) * (1 + ln(2 * pi() * s2)) + ld + ln(det)) AS crit FROM (SELECT *, "
            f"(c - b1 * e1 - b2 * e2 - b3 * e3) / (nn - 3) AS s2 FROM {name}_2) z)",
        ]

    x2, x3 = (e for _, e, _ in TRI)
    out = [
        f"{pre}_d AS MATERIALIZED (SELECT trustcode, {x2} AS x2, {x3} AS x3, {y} AS y FROM d WHERE {where} AND trustcode IS NOT NULL "
        f"AND overall_tri IS NOT NULL AND ({y}) IS NOT NULL)",
        f"{pre}_k AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS a11, sum(x2) AS a12, sum(x3) AS a13, "
        f"sum(x2 * x2) AS a22, sum(x2 * x3) AS a23, sum(x3 * x3) AS a33, sum(x2) AS s2, sum(x3) AS s3, sum(y) AS sy, sum(x2 * y) AS y2, "
        f"sum(x3 * y) AS y3, sum(y * y) AS yy FROM {pre}_d GROUP BY trustcode)",
        *at(f"{pre}_g", "SELECT -12.0E0 + unnest(range(0, 161)) * 0.1E0 AS lg"),
        *at(f"{pre}_f", f"SELECT (SELECT max_by(lg, crit) FROM {pre}_g) + (unnest(range(0, 401)) - 200) * 0.001E0 AS lg"),
        f"{pre}_n AS MATERIALIZED (SELECT lg, crit, lag(crit) OVER (ORDER BY lg) AS lo, lead(crit) OVER (ORDER BY lg) AS hi FROM {pre}_f)",
        *at(f"{pre}_h", f"SELECT CASE WHEN lo IS NULL OR hi IS NULL OR lo - 2 * crit + hi >= 0 THEN lg ELSE lg + 0.0005E0 * (lo - hi) / (lo - 2 * crit + hi) END AS lg FROM {pre}_n WHERE lg = (SELECT max_by(lg, crit) "
                        f"FROM {pre}_f)"),
        f"{pre}_y AS MATERIALIZED (SELECT i, term, b, se, b / se AS z FROM (SELECT 1 AS i, '(Intercept)' AS term, e1 AS b, "
        f"sqrt(s2 * v11) AS se FROM {pre}_h UNION ALL SELECT 2, '{TRI[0][0]}', e2, sqrt(s2 * v22) FROM {pre}_h UNION ALL "
        f"SELECT 3, '{TRI[1][0]}', e3, sqrt(s2 * v33) FROM {pre}_h) q)",
        tails(f"{pre}_p", f"{pre}_y", f"(SELECT nn - 3 FROM {pre}_h)"),
        f"{pre}_e AS MATERIALIZED (SELECT term, b, se, z, p FROM {pre}_p UNION ALL SELECT 'sd(Intercept)', CASE WHEN lg < -9 THEN 0.0E0 ELSE "
        f"sqrt(s2 * pow(10.0E0, lg)) END, "
        f"NULL, NULL, NULL FROM {pre}_h UNION ALL SELECT 'sd(Residual)', sqrt(s2), NULL, NULL, NULL FROM {pre}_h)",
    ]
    assert all(n in sums for n in a)
    return out


#: REML estimates to the digits on which two searches for the maximum agree.
TIDY_REML = ("SELECT term, round(b, 4) AS estimate, round(se, 4) AS std_error, round(z, 3) AS statistic, "
             "round(p, 5) AS p_value FROM {pre}_e")
