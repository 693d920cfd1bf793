"""Aggregate, test and plot-table queries (sections 2.5, 2.7, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import levels as L
from ..functions import recode as R
from ..operators import describe as D
from ..operators import plotdata as P
from ..operators import stattests as ST
from ..operators.derive import reply_time_coalesced, with_ordered_outcomes
from ..sources.scan import SURVEY_SCHEMA
from .common import FINE_SQL, all_waves, derived, fine_times, raw
from .oracle_base import with_derived, with_waves
from .registry import query, rounded

# ------------------------------------------------------------- summaries (2.5)

_NUM = ("los", "reply_time", "reply_time1", "reply_time2", "reply_time3")


def _num_sql(c):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_na, round(min({x}), 8) AS min, "
            f"round(quantile_cont({x}, 0.25), 8) AS q1, round(quantile_cont({x}, 0.5), 8) AS median, "
            f"round(avg({x}), 8) AS mean, round(quantile_cont({x}, 0.75), 8) AS q3, round(max({x}), 8) AS max FROM d")


@query("column_summary", sql=with_derived(" UNION ALL ".join(_num_sql(c) for c in _NUM)))
def column_summary(spark, sf_dir):
    """min, quartiles, mean, max and NA count of the numeric columns (one aggregate)."""
    return rounded(D.column_summary(derived(spark, sf_dir), _NUM), 8)


_PRICE = ("l_quantity", "l_extendedprice", "l_discount")


@query("column_summary_continuous", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS n_na, round(min(x), 4) AS min, "
    f"round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(avg(x), 4) AS mean, "
    f"round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max FROM (SELECT {c}, CAST({c} AS DOUBLE) AS x FROM lineitem) s"
    for c in _PRICE))
def column_summary_continuous(spark, sf_dir):
    """The column summary of measured columns (prices), its quartiles by distributed selection."""
    return rounded(D.column_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _PRICE, few=0), 4)


@query("median_continuous", sql="SELECT " + ", ".join(
    f"round(median(CAST({c} AS DOUBLE)), 4) AS median_{c}" for c in _PRICE) + " FROM lineitem")
def median_continuous(spark, sf_dir):
    """Medians of measured columns by distributed selection."""
    return rounded(D.medians(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _PRICE, few=0), 4)


_CAT = ("outcome", "age_group", "all_gender", "q1", "q74")


@query("column_summary_levels", sql=with_derived(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM d GROUP BY {c}" for c in _CAT)))
def column_summary_levels(spark, sf_dir):
    """Level counts (NULL included) of the categorical columns, one pass."""
    return D.level_counts(raw(spark, sf_dir), _CAT)


_RAW = [f.name for f in SURVEY_SCHEMA.fields]


@query("missing_by_column", sql=with_derived(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS nas, count(*) AS n, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 2) AS prop_na FROM inpatient" for c in _RAW)))
def missing_by_column(spark, sf_dir):
    """NAs, N and share missing (2 decimals) of every source column."""
    return D.missing_by_column(raw(spark, sf_dir), _RAW)


_MT = ("daterec", "q74", "q1", "q22", "los")


@query("missing_by_trust", sql=with_derived(" UNION ALL ".join(
    f"SELECT trustcode, '{c}' AS variable, count(*) - count({c}) AS nas, count(*) AS n, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 2) AS prop_na FROM inpatient GROUP BY trustcode"
    for c in _MT)))
def missing_by_trust(spark, sf_dir):
    """Share missing of chosen columns within each trust."""
    return D.missing_by_trust(raw(spark, sf_dir), _MT)


@query("response_rate_by_trust", sql=with_derived(
    "SELECT trustcode, round(CAST(count(overall_sat) AS DOUBLE) / count(*), 8) AS response_rate FROM d GROUP BY trustcode"))
def response_rate_by_trust(spark, sf_dir):
    """Share of mailed forms with a rating, per trust."""
    from ..operators.joins import response_rate_by_trust as rr
    return rounded(rr(derived(spark, sf_dir)), 8)


@query("overall_response_rate", sql=with_derived(
    "SELECT n_rows, n_returned, n_not_returned, n_mail1, "
    "round(CAST(n_returned AS DOUBLE) / (n_returned + n_not_returned), 8) AS response_rate, "
    "round(CAST(n_mail1 AS DOUBLE) / (n_mail1 + n_not_returned), 8) AS early_rate FROM ("
    "SELECT count(*) AS n_rows, count(CASE WHEN new_outcome = 'Returned' THEN 1 END) AS n_returned, "
    "count(CASE WHEN new_outcome = 'Not returned' THEN 1 END) AS n_not_returned, "
    "count(CASE WHEN reply_strata = 'Mail1' THEN 1 END) AS n_mail1 FROM d) x"))
def overall_response_rate(spark, sf_dir):
    """Response rate and share returned before the first reminder."""
    return rounded(D.overall_response_rate(derived(spark, sf_dir)), 8)


@query("max_received_by_trust", sql=with_derived(
    "SELECT trustcode, max(date_rec) AS max_date_rec FROM d GROUP BY trustcode"))
def max_received_by_trust(spark, sf_dir):
    """Last received date per trust."""
    return D.max_received_by_trust(derived(spark, sf_dir))


_FREQ = ("reply_strata", "early", "late", "overall_tri", "rep_mail")


@query("freq_table", sql=with_derived(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM d GROUP BY {c}" for c in _FREQ)))
def freq_table(spark, sf_dir):
    """One-way counts (NA row included) of five derived factors in one pass."""
    return D.freq_table(derived(spark, sf_dir), _FREQ)


@query("freq_percent", sql=with_derived(
    "SELECT q74, n, round(n * 100.0 / sum(n) OVER (), 8) AS pct FROM "
    "(SELECT q74, count(*) AS n FROM d WHERE q74 IS NOT NULL GROUP BY q74) x"))
def freq_percent(spark, sf_dir):
    """Rating counts with percent of total."""
    return rounded(D.freq_percent(derived(spark, sf_dir), "q74"), 8)


@query("cross_table", sql=with_derived(
    "SELECT reply_strata2, overall_tri, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY reply_strata2), 8) AS prop_row, "
    "round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY overall_tri), 8) AS prop_col, "
    "round(CAST(n AS DOUBLE) / sum(n) OVER (), 8) AS prop_total FROM "
    "(SELECT reply_strata2, overall_tri, count(*) AS n FROM d WHERE reply_strata2 IS NOT NULL AND overall_tri IS NOT NULL "
    "GROUP BY reply_strata2, overall_tri) x"))
def cross_table(spark, sf_dir):
    """First / later reply by satisfaction: counts and row, column, total proportions."""
    return rounded(D.cross_table(derived(spark, sf_dir), "reply_strata2", "overall_tri"), 8)


@query("prop_table_margin", sql=with_derived(
    "SELECT reply_strata, overall_tri, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY overall_tri), 8) AS prop FROM "
    "(SELECT reply_strata, overall_tri, count(*) AS n FROM d WHERE reply_strata IS NOT NULL AND overall_tri IS NOT NULL "
    "GROUP BY reply_strata, overall_tri) x"))
def prop_table_margin(spark, sf_dir):
    """Mailing stratum proportions within each satisfaction group (column margin)."""
    return rounded(D.prop_table_margin(derived(spark, sf_dir), "reply_strata", "overall_tri", 2), 8)


@query("crosstab_wide", sql=with_derived(
    "SELECT rep_mail, count(CASE WHEN overall_tri = 'Excellent' THEN 1 END) AS \"Excellent\", "
    "count(CASE WHEN overall_tri = 'Very good' THEN 1 END) AS \"Very good\", "
    "count(CASE WHEN overall_tri = 'Other' THEN 1 END) AS \"Other\" "
    "FROM d WHERE rep_mail IS NOT NULL AND overall_tri IS NOT NULL GROUP BY rep_mail"))
def crosstab_wide(spark, sf_dir):
    """Repeated mailing by satisfaction as a matrix (pivot with given levels)."""
    return D.crosstab_wide(derived(spark, sf_dir), "rep_mail", "overall_tri", L.SATISFACTION_TRI_LABELS)


@query("median_by_mailing", sql=with_derived(
    "SELECT round(median(CAST(reply_time1 AS DOUBLE)), 8) AS median_reply_time1, "
    "round(median(CAST(reply_time2 AS DOUBLE)), 8) AS median_reply_time2, "
    "round(median(CAST(reply_time3 AS DOUBLE)), 8) AS median_reply_time3 FROM d"))
def median_by_mailing(spark, sf_dir):
    """Median reply time after each mailing."""
    return rounded(D.medians(derived(spark, sf_dir), ("reply_time1", "reply_time2", "reply_time3")), 8)


@query("mean_by_group", sql=with_derived(
    "SELECT overall_tri, round(avg(CAST(reply_time AS DOUBLE)), 8) AS mean_reply_time, count(reply_time) AS n "
    "FROM d WHERE overall_tri IS NOT NULL GROUP BY overall_tri"))
def mean_by_group(spark, sf_dir):
    """Mean reply time by satisfaction."""
    return rounded(D.mean_by_group(derived(spark, sf_dir), "reply_time", "overall_tri"), 8)


@query("returned_without_date", sql=with_derived(
    "SELECT count(CASE WHEN outcome = 'Returned useable questionnaire' THEN 1 END) AS n_returned, "
    "count(CASE WHEN outcome = 'Returned useable questionnaire' AND overall_sat IS NULL THEN 1 END) AS returned_no_rating, "
    "count(CASE WHEN outcome = 'Returned useable questionnaire' AND reply_strata IS NULL THEN 1 END) AS returned_no_strata, "
    "count(CASE WHEN outcome = 'Returned useable questionnaire' AND overall_sat IS NOT NULL AND reply_strata IS NULL "
    "THEN 1 END) AS rated_no_reply_time FROM d"))
def returned_without_date(spark, sf_dir):
    """Usable returns lacking a rating or a reply time."""
    return D.returned_without_date(derived(spark, sf_dir))


# ------------------------------------------------------------------ tests (2.7)

_CLEAN_TRI_SQL = ("CASE WHEN q22 = 'Very clean' THEN 'Very clean' WHEN q22 = 'Fairly clean' THEN 'Fairly clean' "
                  "WHEN q22 IS NULL THEN NULL ELSE 'Other' END")


@query("chi_square_independence", sql=with_derived(
    "SELECT round(statistic, 6) AS statistic, df, n, round(exp(-statistic / 2.0), 8) AS p_value FROM ("
    "SELECT sum((n - e) * (n - e) / e) AS statistic, "
    "CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df, CAST(sum(n) AS BIGINT) AS n FROM ("
    "SELECT a, b, n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e "
    "FROM (SELECT a, b, count(*) AS n FROM (SELECT " + _CLEAN_TRI_SQL + " AS a, early AS b FROM d) s "
    "WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b) c) x) y"))
def chi_square_independence(spark, sf_dir):
    """Chi-square test of cleanliness (3 levels) against early reply (2 levels).

    With 2 degrees of freedom the tail probability is exp(-X^2/2), which the
    oracle states in closed form.
    """
    d = with_ordered_outcomes(derived(spark, sf_dir))
    out = ST.chi_square_independence(d, "clean_tri", "early")
    return out.select(F.round("statistic", 6).alias("statistic"), F.col("df").cast("long").alias("df"),
                      F.col("n").cast("long").alias("n"), F.round("p_value", 8).alias("p_value"))


@query("welch_t_test", sql=with_derived(
    "SELECT n1, round(mean1, 8) AS mean1, round(var1, 6) AS var1, n2, round(mean2, 8) AS mean2, round(var2, 6) AS var2, "
    "round((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2), 6) AS t, "
    "round((var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2) / ((var1 / n1) * (var1 / n1) / (n1 - 1) + "
    "(var2 / n2) * (var2 / n2) / (n2 - 1)), 6) AS df FROM ("
    "SELECT count(CASE WHEN reply_strata2 = 'First' THEN los END) AS n1, avg(CASE WHEN reply_strata2 = 'First' THEN CAST(los AS DOUBLE) END) AS mean1, "
    "var_samp(CASE WHEN reply_strata2 = 'First' THEN CAST(los AS DOUBLE) END) AS var1, "
    "count(CASE WHEN reply_strata2 = 'Later' THEN los END) AS n2, avg(CASE WHEN reply_strata2 = 'Later' THEN CAST(los AS DOUBLE) END) AS mean2, "
    "var_samp(CASE WHEN reply_strata2 = 'Later' THEN CAST(los AS DOUBLE) END) AS var2 FROM d) x"))
def welch_t_test(spark, sf_dir):
    """Welch t test of length of stay between first and later repliers (statistic and df)."""
    out = ST.welch_t_test(derived(spark, sf_dir), "los", "reply_strata2", ("First", "Later"), p_value=False)
    return out.select("n1", F.round("mean1", 8).alias("mean1"), F.round("var1", 6).alias("var1"), "n2",
                      F.round("mean2", 8).alias("mean2"), F.round("var2", 6).alias("var2"),
                      F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


@query("one_way_anova", sql=with_derived(
    "SELECT round(ss_between, 4) AS ss_between, round(ss_within, 4) AS ss_within, df1, df2, "
    "round((ss_between / df1) / (ss_within / df2), 6) AS f FROM ("
    "SELECT sum(n * (mean - grand) * (mean - grand)) AS ss_between, sum((n - 1) * coalesce(var, 0.0)) AS ss_within, "
    "count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM ("
    "SELECT n, mean, var, sum(n * mean) OVER () / sum(n) OVER () AS grand FROM ("
    "SELECT overall_sat, count(*) AS n, avg(CAST(reply_time AS DOUBLE)) AS mean, var_samp(CAST(reply_time AS DOUBLE)) AS var "
    "FROM d WHERE reply_time IS NOT NULL AND overall_sat IS NOT NULL GROUP BY overall_sat) g) h) x"))
def one_way_anova(spark, sf_dir):
    """ANOVA of reply time across the five rating levels (F and degrees of freedom)."""
    out = ST.one_way_anova(derived(spark, sf_dir), "reply_time", "overall_sat", p_value=False)
    return out.select(F.round("ss_between", 4).alias("ss_between"), F.round("ss_within", 4).alias("ss_within"),
                      F.col("df1").cast("long").alias("df1"), F.col("df2").cast("long").alias("df2"),
                      F.round("f", 6).alias("f"))


# ---------------------------------------------------------- plot tables (2.10)

_MAIL_MAP = dict(zip(L.STRATA_LEVELS, L.MAILING_LABELS))
_PLOT_SRC = """plot_src AS (
  SELECT CASE reply_strata WHEN 'Mail1' THEN 'First' WHEN 'Mail2' THEN 'Second' WHEN 'Mail3' THEN 'Third' END AS mailing,
         CAST(CASE WHEN reply_strata = 'Mail1' THEN reply_time1 WHEN reply_strata = 'Mail2' THEN reply_time2
              WHEN reply_strata = 'Mail3' THEN reply_time3 END AS DOUBLE) AS x
  FROM d
),
plot_in AS (SELECT * FROM plot_src WHERE x BETWEEN 0 AND 40)"""


def _plot_input(spark, sf_dir):
    d = derived(spark, sf_dir)
    return d.select(R.relabel("reply_strata", _MAIL_MAP).alias("mailing"),
                    reply_time_coalesced().cast("double").alias("x")).where(F.col("x").between(0, 40))


@query("histogram_density", sql=with_derived(
    "SELECT mailing, CAST(bin AS DOUBLE) AS bin_start, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY mailing), 8) AS density "
    "FROM (SELECT mailing, CAST(floor(x) AS BIGINT) AS bin, count(*) AS n FROM plot_in GROUP BY mailing, CAST(floor(x) AS BIGINT)) h",
    _PLOT_SRC))
def histogram_density(spark, sf_dir):
    """Histogram (1-day bins, 0-40 days) and density of reply time per mailing."""
    return rounded(P.histogram_density(_plot_input(spark, sf_dir), "x", 1.0, by=("mailing",)), 8)


@query("kde_density", sql=with_derived(
    "SELECT g.mailing, CAST(g.j AS INTEGER) AS j, round(g.g0 + g.j * g.step, 6) AS x, "
    "round(sum(v.c * exp(-0.5 * ((g.g0 + g.j * g.step - v.x) / g.bw) * ((g.g0 + g.j * g.step - v.x) / g.bw))) "
    "/ (g.n * g.bw * sqrt(2 * pi())), 8) AS density, round(g.bw, 8) AS bw "
    "FROM grid g JOIN vals v ON g.mailing = v.mailing GROUP BY g.mailing, g.j, g.g0, g.step, g.n, g.bw",
    _PLOT_SRC + """,
vals AS (SELECT mailing, x, count(*) AS c FROM plot_in GROUP BY mailing, x),
prm AS (SELECT mailing, count(*) AS n, coalesce(stddev_samp(x), 0.0) AS sd,
               quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS xmin, max(x) AS xmax
        FROM plot_in GROUP BY mailing),
prm2 AS (SELECT *, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                               WHEN sd > 0 THEN sd ELSE 1.0 END) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM prm),
prm3 AS (SELECT *, xmin - 3.0 * bw AS g0, (xmax - xmin + 6.0 * bw) / 511.0 AS step FROM prm2),
grid AS (SELECT prm3.*, r.j FROM prm3, range(0, 512) r(j))"""))
def kde_density(spark, sf_dir):
    """Gaussian kernel density (rule-of-thumb bandwidth, 512 points) of reply time per mailing."""
    out = P.kde_density(_plot_input(spark, sf_dir), "x", by=("mailing",))
    return out.select("mailing", "j", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"),
                      F.round("bw", 8).alias("bw"))


_KDE_FINE = 64


@query("kde_continuous", sql=with_derived(
    "SELECT g.reply_strata, CAST(g.j AS INTEGER) AS j, round(g.g0 + g.j * g.step, 6) AS x, "
    f"round(sum(v.m * exp(-0.5 * pow((g.g0 + g.j * g.step - g.g0 - v.node * g.bw / {_KDE_FINE}.0E0) / g.bw, 2))) "
    "/ (g.n * g.bw * sqrt(2 * pi())), 8) AS density, round(g.bw, 8) AS bw "
    "FROM grid g JOIN nodes v ON g.reply_strata = v.reply_strata GROUP BY g.reply_strata, g.j, g.g0, g.step, g.n, g.bw",
    f"""fine AS (SELECT reply_strata, {FINE_SQL} AS x FROM d WHERE reply_strata IS NOT NULL AND {FINE_SQL} IS NOT NULL),
prm AS (SELECT reply_strata, count(*) AS n, coalesce(stddev_samp(x), 0.0) AS sd,
               quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS xmin, max(x) AS xmax
        FROM fine GROUP BY reply_strata),
prm2 AS (SELECT *, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                               WHEN sd > 0 THEN sd ELSE 1.0 END) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM prm),
prm3 AS (SELECT *, xmin - 3.0 * bw AS g0, (xmax - xmin + 6.0 * bw) / 511.0 AS step FROM prm2),
grid AS (SELECT prm3.*, r.j FROM prm3, range(0, 512) r(j)),
placed AS (SELECT reply_strata, (x - g0) / bw * {_KDE_FINE}.0E0 AS pos FROM fine JOIN prm3 USING (reply_strata)),
nodes AS (SELECT reply_strata, node, sum(m) AS m FROM (
    SELECT reply_strata, floor(pos) AS node, 1.0E0 - (pos - floor(pos)) AS m FROM placed
    UNION ALL SELECT reply_strata, floor(pos) + 1, pos - floor(pos) FROM placed) s GROUP BY reply_strata, node)"""))
def kde_continuous(spark, sf_dir):
    """Density of a finely divided reply time per stratum, values split between nodes a 64th of the bandwidth apart."""
    rows = fine_times(derived(spark, sf_dir)).where("reply_strata IS NOT NULL")
    out = P.kde_density(rows, "fine_time", by=("reply_strata",), few=0, fine=_KDE_FINE)
    return out.select("reply_strata", "j", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"),
                      F.round("bw", 8).alias("bw"))


@query("boxplot_stats", sql=with_derived(
    "SELECT q.overall_tri, q.n, min(CASE WHEN s.y BETWEEN lo AND hi THEN s.y END) AS ymin, q.lower, q.middle, q.upper, "
    "max(CASE WHEN s.y BETWEEN lo AND hi THEN s.y END) AS ymax, count(CASE WHEN s.y < lo OR s.y > hi THEN 1 END) AS n_out "
    "FROM bx_src s JOIN (SELECT *, lower - 1.5 * (upper - lower) AS lo, upper + 1.5 * (upper - lower) AS hi FROM bx_q) q "
    "ON s.overall_tri = q.overall_tri GROUP BY q.overall_tri, q.n, q.lower, q.middle, q.upper",
    """bx_src AS (SELECT overall_tri, CAST(reply_time AS DOUBLE) AS y FROM d WHERE reply_time IS NOT NULL AND overall_tri IS NOT NULL),
bx_q AS (SELECT overall_tri, count(*) AS n, quantile_cont(y, 0.25) AS lower, quantile_cont(y, 0.5) AS middle,
                quantile_cont(y, 0.75) AS upper FROM bx_src GROUP BY overall_tri)"""))
def boxplot_stats(spark, sf_dir):
    """Box-plot statistics of reply time by satisfaction."""
    return rounded(P.boxplot_stats(derived(spark, sf_dir), "reply_time", "overall_tri"), 8)


_DICT_VARS = ("q74", "q22", "q32", "q49", "age_group", "all_gender")


def _dict_values_sql():
    rows = []
    for var in _DICT_VARS:
        for i, lvl in enumerate(L.DICTIONARY[var]):
            rows.append(f"('{var}', '{lvl}', {i + 1})")
    return ", ".join(rows)


@query("factor_level_codes", sql=with_derived(
    "SELECT v.variable, v.level, v.ord, coalesce(c.n, 0) AS n, "
    "CASE WHEN coalesce(c.n, 0) > 0 THEN CAST(dense_rank() OVER (PARTITION BY v.variable ORDER BY "
    "CASE WHEN coalesce(c.n, 0) > 0 THEN v.ord END ASC NULLS LAST) AS INTEGER) END AS code "
    "FROM (SELECT * FROM (VALUES " + _dict_values_sql() + ") t(variable, level, ord)) v LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS level, count(*) AS n FROM inpatient "
                         f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _DICT_VARS)
    + ") c ON v.variable = c.variable AND v.level = c.level"))
def factor_level_codes(spark, sf_dir):
    """Level dictionary joined to level counts; codes number only the levels in use."""
    d = L.factor_levels(spark, waves=(2009,))
    return D.level_codes(raw(spark, sf_dir), d, _DICT_VARS)


@query("welch_t_test_pvalue")
def welch_t_test_pvalue(spark, sf_dir):
    """Welch t test of length of stay (first vs later repliers) with its two-sided p-value."""
    return ST.welch_t_test(derived(spark, sf_dir), "los", "reply_strata2", ("First", "Later"))


@query("one_way_anova_pvalue")
def one_way_anova_pvalue(spark, sf_dir):
    """ANOVA of reply time across rating levels with the F-test p-value."""
    return ST.one_way_anova(derived(spark, sf_dir), "reply_time", "overall_sat")


@query("cross_table_with_na", sql=with_derived(
    "SELECT reply_strata, outcome, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY reply_strata), 8) AS prop_row, "
    "round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY outcome), 8) AS prop_col, "
    "round(CAST(n AS DOUBLE) / sum(n) OVER (), 8) AS prop_total FROM "
    "(SELECT reply_strata, outcome, count(*) AS n FROM d GROUP BY reply_strata, outcome) x"))
def cross_table_with_na(spark, sf_dir):
    """Mailing stratum by outcome label with the missing stratum kept as its own level."""
    return rounded(D.cross_table(derived(spark, sf_dir), "reply_strata", "outcome", include_na=True), 8)


@query("histogram_by_wave", sql=with_waves(
    "SELECT wave, CAST(bin AS DOUBLE) AS bin_start, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY wave), 8) "
    "AS density FROM (SELECT wave, CAST(date_rec - mail1 AS BIGINT) AS bin, count(*) AS n FROM d WHERE date_rec IS NOT NULL "
    "GROUP BY wave, CAST(date_rec - mail1 AS BIGINT)) h"))
def histogram_by_wave(spark, sf_dir):
    """Histogram of raw days from first mailing to receipt, per wave (1-day bins)."""
    from ..functions.core import reply_days
    from ..operators.derive import with_dates
    d = with_dates(all_waves(spark, sf_dir)).select("wave", reply_days("date_rec", "mail1").alias("days"))
    return rounded(P.histogram_density(d, "days", 1.0, by=("wave",)), 8)


@query("response_rate_by_wave", sql=with_waves(
    "SELECT wave, n_rows, n_returned, n_not_returned, "
    "round(CAST(n_returned AS DOUBLE) / (n_returned + n_not_returned), 8) AS response_rate FROM ("
    "SELECT wave, count(*) AS n_rows, count(CASE WHEN new_outcome = 'Returned' THEN 1 END) AS n_returned, "
    "count(CASE WHEN new_outcome = 'Not returned' THEN 1 END) AS n_not_returned FROM d GROUP BY wave) x"))
def response_rate_by_wave(spark, sf_dir):
    """Returned / (returned + not returned) in each of four waves (one grouped pass)."""
    from ..functions import recode as RC
    no = RC.outcome_class("outcome")
    g = all_waves(spark, sf_dir).groupBy("wave").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(no == "Returned", 1)).alias("n_returned"),
        F.count(F.when(no == "Not returned", 1)).alias("n_not_returned"))
    ret, nr = F.col("n_returned").cast("double"), F.col("n_not_returned").cast("double")
    return g.select("wave", "n_rows", "n_returned", "n_not_returned",
                    F.round(F.try_divide(ret, ret + nr), 8).alias("response_rate"))
