"""Model-fitting and model-output queries (sections 2.8 and 2.9).

Factor levels are alphabetical (first = reference), the order the study's
factors had after its CSV round trip.  Every fit reads the whole wave; the
prediction profiles are the study's own small newdata frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import levels as L
from ..functions import recode as R
from ..functions.core import inv_logit
from ..models import aft as A
from ..models import cox as CX
from ..models.design import Factor, Numeric, build_design, complete_rows, design_frame, profile_frame
from ..models.glm import fit_logit, odds_ratio_rows
from ..models.glmm import fit_glmm_logit
from ..models.lm import fit_lm
from ..models.lmm import fit_lmm
from ..models.ordinal import fit_ordinal
from ..models.suffstats import collapse
from ..models.tree import fit_regression_tree
from ..operators.derive import derive_wave, with_ordered_outcomes
from ..operators.filters import exclude_trusts
from ..operators.joins import attach_response_rate, response_rate_by_trust
from .common import FINE_SQL, all_waves, derived, fine_times
from . import oracle_fit as Q
from .concurrent import run_all
from .oracle_base import with_derived, with_waves
from .registry import query, rounded

TRI = Factor("overall_tri", ("Excellent", "Other", "Very good"))
EMERG = Factor("emergency", ("no", "yes"))
AGE = Factor("age_group", L.AGE_LEVELS)
GENDER = Factor("gender", ("Female", "Male"))
CHOICE = Factor("choice", ("No", "Yes"))
STRATA = Factor("reply_strata", L.STRATA_LEVELS)
LOGLOS = Numeric("log_los")
COVARS = [EMERG, AGE, LOGLOS, GENDER]
FULL = [TRI] + COVARS

PROFILE = {"emergency": "yes", "age_group": "36-50", "log_los": 1.16, "gender": "Male"}


def tidy(table):
    """Coefficient table rounded for comparison across engines."""
    return table.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                        F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def tidy_reml(table):
    """Coefficient table rounded to the digits on which two searches for the REML maximum agree."""
    return table.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"),
                        F.round("statistic", 3).alias("statistic"), F.round("p_value", 5).alias("p_value"))


_COVAR_COLS = ("overall_tri", "emergency", "age_group", "log_los", "gender")


def joint(d, *cols):
    """The wave collapsed to the distinct values of the columns that several fits read: one scan feeds them all."""
    return collapse(d, list(dict.fromkeys(cols)), {"n_rows": F.count(F.lit(1)).cast("double")})


def _tri_profiles(spark, extra=None):
    rows = []
    for lvl in L.SATISFACTION_TRI_LABELS:
        r = {"overall_tri": lvl}
        r.update(extra or {})
        rows.append(r)
    return profile_frame(spark, rows)


# ------------------------------------------------------------------- design

_DM_SQL = (
    "SELECT record, CASE WHEN overall_tri = 'Other' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"overall_triOther\", "
    "CASE WHEN overall_tri = 'Very good' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"overall_triVery good\", "
    "CASE WHEN emergency = 'yes' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS emergencyyes, "
    "CASE WHEN age_group = '36-50' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"age_group36-50\", "
    "CASE WHEN age_group = '51-65' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"age_group51-65\", "
    "CASE WHEN age_group = '66+' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"age_group66+\", "
    "round(log_los, 8) AS log_los, CASE WHEN gender = 'Male' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"genderMale\" "
    "FROM d WHERE overall_tri IS NOT NULL AND emergency IS NOT NULL AND age_group IS NOT NULL "
    "AND log_los IS NOT NULL AND gender IS NOT NULL")


@query("design_matrix", sql=with_derived(_DM_SQL))
def design_matrix(spark, sf_dir):
    """Treatment-coded design of satisfaction + covariates for complete rows."""
    d = derived(spark, sf_dir)
    des = build_design(d, FULL, intercept=False)
    out = design_frame(d, des, keep=["record"])
    return rounded(out.select("record", *[F.col(f"x{i}").alias(n) for i, n in enumerate(des.names)]), 8)


# ------------------------------------------------------------------ linear

_LSF_SQL = """
g AS (SELECT overall_tri, count(*) AS n, avg(CAST(reply_time AS DOUBLE)) AS mean,
             sum((CAST(reply_time AS DOUBLE)) * (CAST(reply_time AS DOUBLE))) AS ss
      FROM d WHERE overall_tri IS NOT NULL AND reply_time IS NOT NULL GROUP BY overall_tri),
tot AS (SELECT sum(ss - n * mean * mean) / (sum(n) - count(*)) AS s2 FROM g),
ref AS (SELECT n AS n0, mean AS m0 FROM g WHERE overall_tri = 'Excellent'),
est AS (
  SELECT '(Intercept)' AS term, m0 AS estimate, sqrt(s2 / n0) AS std_error FROM ref, tot
  UNION ALL
  SELECT 'overall_tri' || overall_tri, mean - m0, sqrt(s2 * (1.0 / n + 1.0 / n0)) FROM g, ref, tot
  WHERE overall_tri <> 'Excellent'
)"""


@query("lm_single_factor", sql=with_derived(
    "SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, "
    "round(estimate / std_error, 4) AS statistic FROM est", _LSF_SQL))
def lm_single_factor(spark, sf_dir):
    """OLS of reply time on satisfaction (equals the level means; SE from pooled variance)."""
    fit = fit_lm(derived(spark, sf_dir), "reply_time", [TRI])
    t = fit.table(spark)
    return t.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("statistic", 4).alias("statistic"))


@query("lm_simple", sql=with_derived(
    "SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 8) AS slope, "
    "round(regr_r2(y, x), 8) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM "
    "(SELECT CAST(overall_sat AS DOUBLE) AS y, CAST(reply_time AS DOUBLE) AS x FROM d WHERE reply_time > 0) s"))
def lm_simple(spark, sf_dir):
    """OLS of the rating code on reply time (subset reply time > 0)."""
    d = derived(spark, sf_dir).where(F.col("reply_time") > 0)
    fit = fit_lm(d, "overall_sat", [Numeric("reply_time")])
    row = [(float(fit.beta[0]), float(fit.beta[1]), float(fit.r2), int(fit.n))]
    out = spark.createDataFrame(row, "intercept double, slope double, r2 double, n long")
    return out.select(F.round("intercept", 6).alias("intercept"), F.round("slope", 8).alias("slope"),
                      F.round("r2", 8).alias("r2"), "n")


_SCORE = [(f"overall_score{v}", f"CASE WHEN overall_sat = {k} THEN 1.0E0 ELSE 0.0E0 END", "overall_sat")
          for v, k in ((25, 4), (50, 3), (75, 2), (100, 1))]
_MULTI = [Q.ONE, *_SCORE, *Q.EMERG, *Q.CHOICE, *Q.AGE, *Q.LOGLOS, *Q.GENDER]
_MULTI_FIT = Q.ols("m", _MULTI, "CAST(reply_time AS DOUBLE)")


@query("lm_multi", sql=Q.with_fit(Q.tidy("m"), [*_MULTI_FIT, *Q.estimates(
    "m", Q.terms_of(_MULTI), "(SELECT s2 FROM m_q)", f"(SELECT n - {len(_MULTI)} FROM m_q)")]))
def lm_multi(spark, sf_dir):
    """OLS of reply time on factor(score) + emergency + choice + age + log LOS + gender."""
    d = derived(spark, sf_dir).withColumn("overall_score", R.satisfaction_score("overall_sat"))
    fit = fit_lm(d, "reply_time", [Factor("overall_score", (0, 25, 50, 75, 100)), EMERG, CHOICE, AGE, LOGLOS,
                                   GENDER])
    return tidy(fit.table(spark))


# a factor nested in satisfaction: its indicator is a combination of the intercept and the satisfaction terms
def _with_nested(d):
    return d.withColumn("nested", F.when(F.col("overall_tri") == "Excellent", "top").when(
        F.col("overall_tri").isNotNull(), "below"))


_ALIASED = [Q.ONE, *Q.TRI, *Q.GENDER]


def _aliased_sql(fit: list) -> str:
    body = Q.tidy("m").replace("FROM m_e", "FROM m_e UNION ALL SELECT 'nestedtop', NULL, NULL, NULL, NULL")
    return Q.with_fit(body, fit)


_ALIASED_LM = Q.ols("m", _ALIASED, "CAST(reply_time AS DOUBLE)")


@query("lm_aliased", sql=_aliased_sql([*_ALIASED_LM, *Q.estimates(
    "m", Q.terms_of(_ALIASED), "(SELECT s2 FROM m_q)", f"(SELECT n - {len(_ALIASED)} FROM m_q)")]))
def lm_aliased(spark, sf_dir):
    """OLS with a nested factor: its coefficient is NULL, the others are those of the fit without it."""
    d = _with_nested(derived(spark, sf_dir))
    return tidy(fit_lm(d, "reply_time", [TRI, Factor("nested", ("below", "top")), GENDER]).table(spark))


@query("logit_aliased", sql=_aliased_sql([*Q.logit("m", _ALIASED, "early", "Late"), *Q.estimates("m", Q.terms_of(_ALIASED))]))
def logit_aliased(spark, sf_dir):
    """Logit of a late reply with a nested factor: its coefficient is NULL."""
    d = _with_nested(derived(spark, sf_dir))
    return tidy(fit_logit(d, "early", "Late", [TRI, Factor("nested", ("below", "top")), GENDER]).table(spark))


_LW_SQL = """
src AS (SELECT CAST(overall_sat AS DOUBLE) AS y, CAST(reply_time AS DOUBLE) AS x, r.response_rate AS w
        FROM d JOIN (SELECT trustcode, CAST(count(overall_sat) AS DOUBLE) / count(*) AS response_rate
                     FROM d GROUP BY trustcode) r ON d.trustcode = r.trustcode
        WHERE reply_time > 0 AND overall_sat IS NOT NULL),
m AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy,
             count(*) AS n FROM src)"""


@query("lm_weighted", sql=with_derived(
    "SELECT round((sy - ((sw * sxy - sx * sy) / (sw * sxx - sx * sx)) * sx) / sw, 6) AS intercept, "
    "round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 8) AS slope, n FROM m", _LW_SQL))
def lm_weighted(spark, sf_dir):
    """Rating code on reply time weighted by the trust response rate (joined first)."""
    d = derived(spark, sf_dir)
    d = attach_response_rate(d, response_rate_by_trust(d)).where(F.col("reply_time") > 0)
    fit = fit_lm(d, "overall_sat", [Numeric("reply_time")], weights="response_rate")
    out = spark.createDataFrame([(float(fit.beta[0]), float(fit.beta[1]), int(fit.n))],
                                "intercept double, slope double, n long")
    return out.select(F.round("intercept", 6).alias("intercept"), F.round("slope", 8).alias("slope"), "n")


_LOGTIME = [Q.ONE, *Q.TRI]


@query("coefficient_table", sql=Q.with_fit(Q.tidy("m"), [
    *Q.ols("m", _LOGTIME, "CASE WHEN reply_time > 0 THEN ln(CAST(reply_time AS DOUBLE)) END"),
    *Q.estimates("m", Q.terms_of(_LOGTIME), "(SELECT s2 FROM m_q)", "(SELECT n - 3 FROM m_q)")]))
def coefficient_table(spark, sf_dir):
    """Tidy table (estimate, SE, t, p) of log reply time on satisfaction."""
    fit = fit_lm(derived(spark, sf_dir), "reply_time", [TRI], log_y=True)
    return tidy(fit.table(spark))


@query("factor_level_means", sql=with_derived(
    "SELECT overall_tri, round(avg(CAST(reply_time AS DOUBLE)), 6) AS mean_time, "
    "round(exp(avg(ln(CAST(reply_time AS DOUBLE)))), 6) AS geo_mean_time FROM d "
    "WHERE overall_tri IS NOT NULL AND reply_time > 0 GROUP BY overall_tri"))
def factor_level_means(spark, sf_dir):
    """Intercept + effect per level, plain and exp of the log-time model."""
    d = derived(spark, sf_dir).where(F.col("reply_time") > 0)
    plain = fit_lm(d, "reply_time", [TRI])
    logm = fit_lm(d, "reply_time", [TRI], log_y=True)
    rows = []
    for k, lvl in enumerate(TRI.levels):
        b_plain = plain.beta[0] + (plain.beta[k] if k > 0 else 0.0)
        b_log = logm.beta[0] + (logm.beta[k] if k > 0 else 0.0)
        rows.append((lvl, float(b_plain), float(np.exp(b_log))))
    out = spark.createDataFrame(rows, "overall_tri string, mean_time double, geo_mean_time double")
    return out.select("overall_tri", F.round("mean_time", 6).alias("mean_time"),
                      F.round("geo_mean_time", 6).alias("geo_mean_time"))


@query("predict_linear", sql=Q.with_fit(
    "SELECT s.overall_score, round(sum(m_b.b * CASE m_t.term WHEN '(Intercept)' THEN 1.0E0 WHEN 'emergencyyes' THEN 1.0E0 "
    "WHEN 'age_group36-50' THEN 1.0E0 WHEN 'log_los' THEN 1.0E0 WHEN 'overall_score' || s.overall_score THEN 1.0E0 "
    "ELSE 0.0E0 END), 6) AS fit FROM m_b JOIN m_t USING (i), (VALUES (0), (25), (50), (75), (100)) s(overall_score) "
    "GROUP BY s.overall_score", [*_MULTI_FIT, Q.names("m", Q.terms_of(_MULTI))]))
def predict_linear(spark, sf_dir):
    """Predicted reply time of the full OLS at the study's profiles (scores 0..100)."""
    d = derived(spark, sf_dir).withColumn("overall_score", R.satisfaction_score("overall_sat"))
    fit = fit_lm(d, "reply_time", [Factor("overall_score", (0, 25, 50, 75, 100)), EMERG, CHOICE, AGE, LOGLOS,
                                   GENDER])
    prof = profile_frame(spark, [{"overall_score": s, "emergency": "yes", "choice": "No", "age_group": "36-50",
                                  "log_los": 1.0, "gender": "Female"} for s in (0, 25, 50, 75, 100)])
    return fit.predict(prof, "fit").select(F.col("overall_score").cast("int").alias("overall_score"),
                                           F.round("fit", 6).alias("fit"))


# ----------------------------------------------------------------- logistic

_LOGIT = [Q.ONE, *Q.FULL, *Q.CHOICE]


@query("logit", sql=Q.with_fit(Q.tidy("m"), [*Q.logit("m", _LOGIT, "early", "Late"),
                                             *Q.estimates("m", Q.terms_of(_LOGIT))]))
def logit(spark, sf_dir):
    """Logit of a late reply (> 14 days) on satisfaction and covariates."""
    fit = fit_logit(derived(spark, sf_dir), "early", "Late", FULL + [CHOICE])
    return tidy(fit.table(spark))


_LOGIT1_SQL = """
g AS (SELECT overall_tri, CAST(sum(CASE WHEN rep_mail = 'Repeated' THEN 1 ELSE 0 END) AS DOUBLE) AS s,
             CAST(count(*) AS DOUBLE) AS m
      FROM d WHERE overall_tri IS NOT NULL AND rep_mail IS NOT NULL GROUP BY overall_tri),
ref AS (SELECT s AS s0, m AS m0 FROM g WHERE overall_tri = 'Excellent'),
est AS (
  SELECT '(Intercept)' AS term, ln(s0 / (m0 - s0)) AS estimate, sqrt(1.0 / s0 + 1.0 / (m0 - s0)) AS std_error FROM ref
  UNION ALL
  SELECT 'overall_tri' || overall_tri, ln(s / (m - s)) - ln(s0 / (m0 - s0)),
         sqrt(1.0 / s + 1.0 / (m - s) + 1.0 / s0 + 1.0 / (m0 - s0)) FROM g, ref WHERE overall_tri <> 'Excellent'
)"""


@query("logit_single_factor", sql=with_derived(
    "SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error FROM est", _LOGIT1_SQL))
def logit_single_factor(spark, sf_dir):
    """Logit of a repeated mailing on satisfaction (closed form: log-odds by level)."""
    fit = fit_logit(derived(spark, sf_dir), "rep_mail", "Repeated", [TRI])
    return fit.table(spark).select("term", F.round("estimate", 6).alias("estimate"),
                                   F.round("std_error", 6).alias("std_error"))


_ODDS = [Q.ONE, *Q.FULL]
_ODDS_FIT = Q.logit("m", _ODDS, "early", "Late")


@query("odds_ratio_table", sql=Q.with_fit(
    "SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b) * se, 6) AS std_error FROM m_e",
    [*_ODDS_FIT, *Q.estimates("m", Q.terms_of(_ODDS))]))
def odds_ratio_table(spark, sf_dir):
    """exp(coefficients) of the late-reply logit with delta-method standard errors."""
    fit = fit_logit(derived(spark, sf_dir), "early", "Late", FULL)
    orr, se = odds_ratio_rows(fit)
    rows = [(n, round(float(o), 6), round(float(s), 6)) for n, o, s in zip(fit.design.names, orr, se)]
    return spark.createDataFrame(rows, "term string, odds_ratio double, std_error double")


@query("predict_probability", sql=with_derived(
    "SELECT overall_tri, round(CAST(sum(CASE WHEN rep_mail = 'Repeated' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 8) "
    "AS probability FROM d WHERE overall_tri IS NOT NULL AND rep_mail IS NOT NULL GROUP BY overall_tri"))
def predict_probability(spark, sf_dir):
    """P(repeated mailing) by satisfaction from the one-factor logit (= group share)."""
    fit = fit_logit(derived(spark, sf_dir), "rep_mail", "Repeated", [TRI])
    prof = _tri_profiles(spark)
    out = prof.withColumn("probability", inv_logit(fit.linear_score()))
    return out.select("overall_tri", F.round("probability", 8).alias("probability"))


@query("fitted_values", sql=Q.with_fit(
    f"SELECT record, round(1.0E0 / (1.0E0 + exp(-({Q.linear('m', _ODDS)}))), 6) AS fitted FROM d "
    f"WHERE early IS NOT NULL AND {Q.present(_ODDS)}", _ODDS_FIT))
def fitted_values(spark, sf_dir):
    """Fitted probability of a late reply for every training row."""
    d = derived(spark, sf_dir)
    fit = fit_logit(d, "early", "Late", FULL)
    rows = complete_rows(d, fit.design, extra=["early"])
    return rows.select("record", F.round(inv_logit(fit.linear_score()), 6).alias("fitted"))


# ------------------------------------------------------------ mixed models

@query("random_intercept_lmm", sql=Q.with_fit(Q.TIDY_REML.format(pre="m"), Q.lmm_tri("m", "CAST(reply_time AS DOUBLE)")))
def random_intercept_lmm(spark, sf_dir):
    """REML fit of reply time ~ satisfaction + (1 | trust)."""
    return tidy_reml(fit_lmm(derived(spark, sf_dir), "reply_time", [TRI], "trustcode").table(spark))


@query("random_intercept_logit")
def random_intercept_logit(spark, sf_dir):
    """Laplace fit of later (vs first) reply ~ satisfaction + (1 | trust)."""
    fit = fit_glmm_logit(derived(spark, sf_dir), "reply_strata2", "Later", [TRI], "trustcode")
    return fit.table(spark)


def _mixed_later(spark, sf_dir, terms):
    return fit_glmm_logit(derived(spark, sf_dir), "reply_strata2", "Later", terms, "trustcode")


@query("random_intercept_logit_full")
def random_intercept_logit_full(spark, sf_dir):
    """Laplace fit of later (vs first) reply ~ satisfaction + covariates + (1 | trust)."""
    return _mixed_later(spark, sf_dir, FULL).table(spark)


@query("random_intercept_logit_early")
def random_intercept_logit_early(spark, sf_dir):
    """Laplace fit of a late reply (> 14 days) ~ satisfaction + (1 | trust)."""
    return fit_glmm_logit(derived(spark, sf_dir), "early", "Late", [TRI], "trustcode").table(spark)


@query("odds_ratio_mixed")
def odds_ratio_mixed(spark, sf_dir):
    """exp(fixed effects) of the mixed later-reply logit with delta-method standard errors."""
    fit = _mixed_later(spark, sf_dir, [TRI])
    orr, se = odds_ratio_rows(fit)
    rows = [(n, round(float(o), 6), round(float(s), 6)) for n, o, s in zip(fit.design.names, orr, se)]
    return spark.createDataFrame(rows, "term string, odds_ratio double, std_error double")


@query("fitted_values_mixed")
def fitted_values_mixed(spark, sf_dir):
    """Fitted probability of a later reply for every training row: fixed effects plus the trust's conditional mode."""
    d = derived(spark, sf_dir)
    fit = fit_glmm_logit(d, "reply_strata2", "Later", [TRI], "trustcode")
    return fit.fitted(d, "reply_strata2").select("record", F.round("fitted", 6).alias("fitted"))


# ------------------------------------------------------------ survival fits

def _aft(spark, sf_dir, terms, time="reply_time", data=None):
    """AFT of the wave, or of a table that joint() made of it."""
    if data is not None:
        return A.fit_loglogistic(data, time, "event", terms, cluster="trustcode", count="n_rows")
    return A.fit_loglogistic(derived(spark, sf_dir), time, "event", terms, cluster="trustcode")


_AFT1, _AFTF = [Q.ONE, *Q.TRI], [Q.ONE, *Q.FULL]
_AFT1_FIT = Q.aft("m", _AFT1, cluster="trustcode")


@query("aft_loglogistic", sql=Q.with_fit(Q.tidy("m"), [*_AFT1_FIT, *Q.estimates(
    "m", Q.terms_of(_AFT1, "Log(scale)"), var="w")]))
def aft_loglogistic(spark, sf_dir):
    """Log-logistic AFT of reply time on satisfaction, robust SE clustered by trust."""
    return tidy(_aft(spark, sf_dir, [TRI]).table(spark))


@query("aft_loglogistic_full", sql=Q.with_fit(Q.tidy("m"), [
    *Q.aft("m", _AFTF, cluster="trustcode"), *Q.estimates("m", Q.terms_of(_AFTF, "Log(scale)"), var="w")]))
def aft_loglogistic_full(spark, sf_dir):
    """Log-logistic AFT with satisfaction and covariates, robust SE by trust."""
    return tidy(_aft(spark, sf_dir, FULL).table(spark))


@query("cluster_sandwich", sql=Q.with_fit(
    "SELECT term, round(b, 6) AS estimate, round(sqrt(v.v), 6) AS se_model, round(sqrt(w.v), 6) AS se_robust FROM m_t t "
    "JOIN m_b b USING (i) JOIN m_v v ON v.i = t.i AND v.j = t.i JOIN m_w w ON w.i = t.i AND w.j = t.i",
    [*_AFT1_FIT, Q.names("m", Q.terms_of(_AFT1, "Log(scale)"))]))
def cluster_sandwich(spark, sf_dir):
    """Model-based vs cluster-robust standard errors of the log-logistic AFT."""
    fit = _aft(spark, sf_dir, [TRI])
    se_m = np.sqrt(np.diag(fit.cov))
    se_r = np.sqrt(np.diag(fit.robust_cov))
    rows = [(n, *(round(float(v), 6) for v in r)) for n, *r in zip(fit.names, fit.theta, se_m, se_r)]
    return spark.createDataFrame(rows, "term string, estimate double, se_model double, se_robust double")


@query("aft_weibull", sql=Q.with_fit(Q.tidy("m"), [
    *Q.aft("m", _AFT1, dist="weibull"), *Q.estimates("m", Q.terms_of(_AFT1, "Log(scale)"))]))
def aft_weibull(spark, sf_dir):
    """Weibull AFT of reply time on satisfaction: estimates, model-based standard errors, z and p."""
    return tidy(A.fit_weibull(derived(spark, sf_dir), "reply_time", "event", [TRI]).table(spark))


@query("refit_without_trusts", sql=Q.with_fit(
    "SELECT term, round(a.b, 6) AS estimate_all, round(s.b, 6) AS estimate_subset, round(s.b - a.b, 6) AS difference "
    "FROM a_t JOIN a_b a USING (i) JOIN s_b s USING (i)",
    [*Q.aft("a", _AFTF), *Q.aft("s", _AFTF, where="trustcode NOT IN ('T3', 'T17')"),
     Q.names("a", Q.terms_of(_AFTF, "Log(scale)"))]))
def refit_without_trusts(spark, sf_dir):
    """Full AFT with all trusts vs without two trusts: estimates side by side."""
    d = joint(derived(spark, sf_dir), "trustcode", "reply_time", "event", *_COVAR_COLS)
    full, sub = run_all([lambda: _aft(spark, sf_dir, FULL, data=d),
                         lambda: _aft(spark, sf_dir, FULL, data=exclude_trusts(d, spark, ["T3", "T17"]))])
    rows = [(n, round(float(a), 6), round(float(b), 6), round(float(b - a), 6))
            for n, a, b in zip(full.names, full.theta, sub.theta)]
    return spark.createDataFrame(rows, "term string, estimate_all double, estimate_subset double, difference double")


#: The study's profile as a table of one row a satisfaction level.
_PROFILES = ("(SELECT overall_tri, 'yes' AS emergency, '36-50' AS age_group, 1.16E0 AS log_los, 'Male' AS gender FROM "
             "(VALUES ('Excellent'), ('Very good'), ('Other')) v(overall_tri)) f")


@query("predict_aft", sql=Q.with_fit(
    f"SELECT overall_tri, round(exp({Q.linear('m', _AFTF)}), 6) AS predicted_time FROM {_PROFILES}", Q.aft("m", _AFTF)))
def predict_aft(spark, sf_dir):
    """Predicted reply time exp(x'b) of the full AFT at the study's profiles."""
    fit = _aft(spark, sf_dir, FULL)
    prof = _tri_profiles(spark, PROFILE)
    return prof.withColumn("predicted_time", F.round(F.exp(fit.linear_score()), 6)).select("overall_tri", "predicted_time")


@query("loglogistic_hazard", sql=Q.with_fit(
    "SELECT record, reply_time, round(CASE WHEN t > 0 THEN lam * (1 / s) * pow(lam * t, 1 / s - 1) / (1 + pow(lam * t, 1 / s)) END, 8) "
    "AS hazard, round(lam * s * pow(lam * t, s) / (1 + pow(lam * t, s + 1)), 8) AS hazard_source FROM (SELECT record, reply_time, "
    "CAST(reply_time AS DOUBLE) AS t, (SELECT exp(-b) FROM m_b WHERE i = 1) AS lam, (SELECT exp(b) FROM m_b WHERE i = 2) AS s "
    "FROM d WHERE reply_time IS NOT NULL) q", Q.aft("m", [Q.ONE])))
def loglogistic_hazard(spark, sf_dir):
    """Baseline log-logistic hazard (intercept-only fit) at every row's reply time."""
    d = derived(spark, sf_dir)
    fit = A.fit_loglogistic(d, "reply_time", "event", [])
    lam = float(np.exp(-fit.beta[0]))
    rows = d.where(F.col("reply_time").isNotNull())
    return rows.select("record", "reply_time",
                       F.round(A.loglogistic_hazard(F.col("reply_time"), lam, 1.0 / fit.scale), 8).alias("hazard"),
                       F.round(A.loglogistic_hazard(F.col("reply_time"), lam, fit.scale, form="source"), 8)
                       .alias("hazard_source"))


_COX_FIT = Q.cox("m", Q.TRI)


@query("cox_ph", sql=Q.with_fit(Q.tidy("m"), [*_COX_FIT, *Q.estimates("m", Q.terms_of(Q.TRI))]))
def cox_ph(spark, sf_dir):
    """Cox model (Efron ties) of reply on satisfaction, model-based standard errors."""
    return tidy(CX.fit_cox(derived(spark, sf_dir), "reply_time", "event", [TRI]).table(spark))


@query("cox_ph_robust")
def cox_ph_robust(spark, sf_dir):
    """Cox model (Efron ties) of reply on satisfaction, robust SE clustered by trust."""
    fit = CX.fit_cox(derived(spark, sf_dir), "reply_time", "event", [TRI], cluster="trustcode")
    return fit.table(spark, robust=True)


_ZPH = [
    "g0 AS MATERIALIZED (SELECT time, sum(w) AS n, sum(w * event) AS e FROM m_s GROUP BY time)",
    "g1 AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM g0)",
    "g2 AS MATERIALIZED (SELECT time, 1.0E0 - exp(coalesce(sum(CASE WHEN e < risk THEN ln(1.0E0 - e / risk) END) OVER (ORDER BY time "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0)) AS g FROM g1)",
    "ev AS MATERIALIZED (SELECT s.rid, s.time, s.w, g.g FROM m_s s JOIN g2 g USING (time) WHERE s.event = 1)",
    "mean_g AS MATERIALIZED (SELECT sum(w * g) / sum(w) AS gbar, sum(w) AS dtot FROM ev)",
    "sgg AS MATERIALIZED (SELECT sum(w * (g - gbar) * (g - gbar)) AS v FROM ev, mean_g)",
    "sgr AS MATERIALIZED (SELECT x.i, sum(ev.w * (ev.g - gbar) * (x.x - (z.s1 * z.A0 - z.e1 * z.A1) / z.d)) AS v FROM ev "
    "JOIN m_x x USING (rid) JOIN m_z z ON z.time = ev.time AND z.i = x.i, mean_g GROUP BY x.i)",
    "zp AS MATERIALIZED (SELECT q.i, t.term, q.u, q.u * q.u / (dtot * v.v * sgg.v) AS chisq, sqrt(q.u * q.u / (dtot * v.v * sgg.v)) AS z "
    "FROM (SELECT v.i, any_value(dtot) * sum(v.v * r.v) AS u FROM m_v v JOIN sgr r ON r.i = v.j, mean_g GROUP BY v.i) q "
    "JOIN m_v v ON v.i = q.i AND v.j = q.i JOIN m_t t ON t.i = q.i, mean_g, sgg)",
    Q.tails("zq", "zp"),
]


# the joint test has two degrees of freedom here, whose upper tail is exp(-x / 2)
_GLOBAL = ("joint AS (SELECT any_value(dtot) * sum(a.v * v.v * b.v) / any_value(sgg.v) AS chisq FROM sgr a "
           "JOIN m_v v ON v.i = a.i JOIN sgr b ON b.i = v.j, mean_g, sgg)")


@query("cox_zph", sql=Q.with_fit(
    "SELECT term, round(u, 3) AS sum_g_scaled, round(chisq, 5) AS chisq, 1 AS df, round(p, 6) AS p_value FROM zq UNION ALL "
    "SELECT 'GLOBAL', NULL, round(chisq, 5), 2, round(exp(-chisq / 2), 6) FROM joint",
    [*_COX_FIT, Q.names("m", Q.terms_of(Q.TRI)), *_ZPH, _GLOBAL]))
def cox_zph(spark, sf_dir):
    """Proportional-hazards check (scaled Schoenfeld residuals against time), each term and all together."""
    d = derived(spark, sf_dir)
    fit = CX.fit_cox(d, "reply_time", "event", [TRI])
    out = CX.schoenfeld_test(d, fit, "reply_time", "event", spark)
    return out.select("term", F.round("sum_g_scaled", 3).alias("sum_g_scaled"), F.round("chisq", 5).alias("chisq"),
                      "df", F.round("p_value", 6).alias("p_value"))


_FINE_FIT = Q.cox("m", Q.TRI, time=FINE_SQL)


@query("cox_continuous", sql=Q.with_fit(Q.tidy("m"), [*_FINE_FIT, *Q.estimates("m", Q.terms_of(Q.TRI))]))
def cox_continuous(spark, sf_dir):
    """Cox model on a finely divided reply time, the risk sets summed in blocks of the time axis."""
    return tidy(CX.fit_cox(fine_times(derived(spark, sf_dir)), "fine_time", "event", [TRI], many=0).table(spark))


_TRI_ROWS = "(VALUES ('Excellent'), ('Very good'), ('Other')) v(overall_tri)"


@query("predict_cox_risk", sql=Q.with_fit(
    f"SELECT overall_tri, round(exp({Q.linear('m', Q.TRI)} - (SELECT sum(a.m * b.b) FROM mean_x a JOIN m_b b USING (i))), 6) AS risk "
    f"FROM {_TRI_ROWS}",
    [*_COX_FIT, "mean_x AS MATERIALIZED (SELECT x.i, sum(s.w * x.x) / sum(s.w) AS m FROM m_x x JOIN m_s s USING (rid) GROUP BY x.i)"]))
def predict_cox_risk(spark, sf_dir):
    """Relative risk exp((x - mean)'b) per satisfaction level."""
    fit = CX.fit_cox(derived(spark, sf_dir), "reply_time", "event", [TRI])
    return _tri_profiles(spark).withColumn("risk", F.round(CX.risk_score(fit), 6)).select("overall_tri", "risk")


@query("cox_survival_curve", sql=Q.with_fit(
    f"SELECT overall_tri, time, round(exp(-cumhaz * exp({Q.linear('m', Q.TRI)})), 6) AS surv FROM {_TRI_ROWS}, (SELECT time, "
    "sum(dh) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumhaz FROM m_h) h", _COX_FIT))
def cox_survival_curve(spark, sf_dir):
    """S(t | satisfaction) = exp(-H0(t) * risk) per level, H0 the Efron baseline."""
    d = derived(spark, sf_dir)
    fit = CX.fit_cox(d, "reply_time", "event", [TRI])
    h0 = CX.baseline_hazard(d, fit, "reply_time", "event")
    risks = _tri_profiles(spark).withColumn("risk", CX.risk_score(fit)).select("overall_tri", "risk")
    # three profile rows: attached to each time as a literal array, no join
    rr = {r["overall_tri"]: float(r["risk"]) for r in risks.collect()}
    arr = F.array(*[F.struct(F.lit(k).alias("overall_tri"), F.lit(v).alias("risk")) for k, v in rr.items()])
    out = h0.select("time", "cumhaz", F.explode(arr).alias("p"))
    return out.select("p.overall_tri", "time", F.round(F.exp(-F.col("cumhaz") * F.col("p.risk")), 6).alias("surv"))


# ------------------------------------------------------------------ ordinal

TRI_ORD = L.SATISFACTION_TRI_ORDERED


_ORD = [*Q.TIME, *Q.COVARS]
_ORD_FIT = Q.ordinal("m", _ORD, "overall_tri", list(TRI_ORD))
_CUTS = [f"{a}|{b}" for a, b in zip(TRI_ORD[:-1], TRI_ORD[1:])]


@query("ordinal_logit", sql=Q.with_fit(Q.tidy("m"), [*_ORD_FIT, *Q.estimates("m", Q.terms_of(_ORD, *_CUTS))]))
def ordinal_logit(spark, sf_dir):
    """Proportional odds of satisfaction (Other < Very good < Excellent) on reply time + covariates."""
    fit = fit_ordinal(derived(spark, sf_dir), "overall_tri", TRI_ORD, [Numeric("reply_time")] + COVARS)
    return tidy(fit.table(spark))


@query("ordinal_logit_intercepts", sql=with_derived(
    "SELECT term, round(ln(c / (1.0 - c)), 6) AS estimate FROM ("
    "SELECT 'Other|Very good' AS term, CAST(sum(CASE WHEN overall_tri = 'Other' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS c "
    "FROM d WHERE overall_tri IS NOT NULL UNION ALL "
    "SELECT 'Very good|Excellent', CAST(sum(CASE WHEN overall_tri IN ('Other', 'Very good') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) "
    "FROM d WHERE overall_tri IS NOT NULL) x"))
def ordinal_logit_intercepts(spark, sf_dir):
    """Intercept-only proportional odds: thresholds equal the cumulative logits."""
    fit = fit_ordinal(derived(spark, sf_dir), "overall_tri", TRI_ORD, [])
    return fit.table(spark).select("term", F.round("estimate", 6).alias("estimate"))


_STRATA_ORD = [*Q.STRATA, *Q.COVARS]
_SCALES = {"overall_tri": TRI_ORD, "clean_tri": L.CLEAN_TRI_ORDERED, "doc_conf": L.CONFIDENCE_ORDERED,
           "nurse_conf": L.CONFIDENCE_ORDERED, "call_but": L.CALL_BUTTON_ORDERED}


_SCALE_SRC = """,
o AS (SELECT *, CASE WHEN q22 IN ('Very clean', 'Fairly clean') THEN q22 WHEN q22 IS NULL THEN NULL ELSE 'Other' END AS clean_tri,
  q32 AS doc_conf, q36 AS nurse_conf, q49 AS call_but FROM d)"""


def _scale_fits(pre: str = "z") -> list[str]:
    return [c for k, (r, lv) in enumerate(_SCALES.items())
            for c in Q.ordinal(f"{pre}{k}", _STRATA_ORD, r, list(lv), source="o")]


def _cuts(levels) -> list[str]:
    return [f"{a}|{b}" for a, b in zip(levels[:-1], levels[1:])]


def _scale_probs() -> str:
    """P(level) of each answer scale by stratum at the study's profile, in rows."""
    parts = []
    for k, (r, lv) in enumerate(_SCALES.items()):
        p, cuts = len(_STRATA_ORD), len(lv) - 1
        eta = Q.linear(f"z{k}", _STRATA_ORD)
        cdf = ["0.0E0", *[f"1.0E0 / (1.0E0 + exp(eta - (SELECT b FROM z{k}_b WHERE i = {p + c})))" for c in range(1, cuts + 1)], "1.0E0"]
        for n, level in enumerate(lv):
            parts.append(f"SELECT '{r}' AS response, reply_strata, '{level}' AS level, round({cdf[n + 1]} - {cdf[n]}, 6) AS probability "
                         f"FROM (SELECT reply_strata, {eta} AS eta FROM profile) q")
    return " UNION ALL ".join(parts)


_PROFILE_CTE = ("profile AS MATERIALIZED (SELECT reply_strata, 'yes' AS emergency, '36-50' AS age_group, 1.16E0 AS log_los, "
                "'Male' AS gender FROM (VALUES ('Mail1'), ('Mail2'), ('Mail3')) v(reply_strata))")


@query("predict_ordinal_scales", sql=Q.with_fit(_scale_probs(), [*_scale_fits(), _PROFILE_CTE], _SCALE_SRC))
def predict_ordinal_scales(spark, sf_dir):
    """Class probabilities of all five ordered answers by mailing stratum at the study's profile."""
    d = joint(with_ordered_outcomes(derived(spark, sf_dir)), "reply_strata", *_COVAR_COLS, *_SCALES)
    fits = run_all([lambda r=r, lv=lv: fit_ordinal(d, r, lv, [STRATA] + COVARS, count="n_rows") for r, lv in _SCALES.items()])
    prof = profile_frame(spark, [dict(reply_strata=s, **PROFILE) for s in L.STRATA_LEVELS])
    out = None
    for resp, fit in zip(_SCALES, fits):
        wide = fit.class_probabilities(prof)
        pairs = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.round(F.col(c), 6).alias("probability"))
                                    for lv, c in zip(fit.levels, fit.prob_columns())])).alias("q")
        t = wide.select(F.lit(resp).alias("response"), "reply_strata", pairs).select("response", "reply_strata", "q.*")
        out = t if out is None else out.unionByName(t)
    return out


@query("ordinal_logit_scales", sql=Q.with_fit(
    " UNION ALL ".join(f"({Q.tidy(f'z{k}').replace('SELECT term', f'SELECT {chr(39)}{r}{chr(39)} AS response, term')})"
                       for k, r in enumerate(_SCALES)),
    [*_scale_fits(), *[c for k, lv in enumerate(_SCALES.values()) for c in Q.estimates(
        f"z{k}", Q.terms_of(_STRATA_ORD, *_cuts(lv)))]], _SCALE_SRC))
def ordinal_logit_scales(spark, sf_dir):
    """Proportional odds of five ordered answers on the mailing stratum + covariates."""
    d = joint(with_ordered_outcomes(derived(spark, sf_dir)), "reply_strata", *_COVAR_COLS, *_SCALES)
    fits = run_all([lambda r=r, lv=lv: fit_ordinal(d, r, lv, [STRATA] + COVARS, count="n_rows") for r, lv in _SCALES.items()])
    out = None
    for resp, fit in zip(_SCALES, fits):
        t = tidy(fit.table(spark)).withColumn("response", F.lit(resp))
        out = t if out is None else out.unionByName(t)
    return out


def _class_sql(eta: str, p: int) -> str:
    """P(level) of the three satisfaction levels for a linear score, from the thresholds after p slopes."""
    low, high = (f"1.0E0 / (1.0E0 + exp(({eta}) - (SELECT b FROM m_b WHERE i = {p + k})))" for k in (1, 2))
    return f"{low} AS c1, {high} AS c2"


@query("predict_ordinal", sql=Q.with_fit(
    "SELECT reply_strata, round(c1, 6) AS \"p_Other\", round(c2 - c1, 6) AS \"p_Very_good\", round(1 - c2, 6) AS \"p_Excellent\", "
    "CASE WHEN c1 >= c2 - c1 AND c1 >= 1 - c2 THEN 'Other' WHEN c2 - c1 >= 1 - c2 THEN 'Very good' ELSE 'Excellent' END AS predicted "
    f"FROM (SELECT reply_strata, {_class_sql(Q.linear('m', _STRATA_ORD), len(_STRATA_ORD))} FROM (SELECT reply_strata, "
    "'yes' AS emergency, '36-50' AS age_group, 1.16E0 AS log_los, 'Male' AS gender FROM (VALUES ('Mail1'), ('Mail2'), ('Mail3')) "
    "v(reply_strata)) f) q", Q.ordinal("m", _STRATA_ORD, "overall_tri", list(TRI_ORD))))
def predict_ordinal(spark, sf_dir):
    """Class probabilities and most likely level by mailing stratum at the study's profile."""
    fit = fit_ordinal(derived(spark, sf_dir), "overall_tri", TRI_ORD, [STRATA] + COVARS)
    prof = profile_frame(spark, [dict(reply_strata=s, **PROFILE) for s in L.STRATA_LEVELS])
    return fit.class_probabilities(prof).select(
        "reply_strata", *[F.round(c, 6).alias(c) for c in fit.prob_columns()], "predicted")


@query("effect_profile", sql=Q.with_fit(
    "SELECT round(t, 6) AS reply_time, round(c1, 6) AS \"p_Other\", round(c2 - c1, 6) AS \"p_Very_good\", "
    f"round(1 - c2, 6) AS \"p_Excellent\" FROM (SELECT t, {_class_sql('(SELECT b FROM m_b WHERE i = 1) * t + other', len(_ORD))} "
    "FROM (SELECT lo + k * (hi - lo) / 19.0E0 AS t, other FROM (SELECT unnest(range(0, 20)) AS k) g, (SELECT min(x) AS lo, max(x) AS hi "
    "FROM m_x WHERE i = 1) r, (SELECT sum(a.m * b.b) AS other FROM (SELECT x.i, sum(s.w * x.x) / sum(s.w) AS m FROM m_x x "
    "JOIN m_s s USING (rid) WHERE x.i > 1 GROUP BY x.i) a JOIN m_b b USING (i)) o) q) z", _ORD_FIT))
def effect_profile(spark, sf_dir):
    """Class probabilities over a grid of reply times, other design columns at their means."""
    d = derived(spark, sf_dir)
    fit = fit_ordinal(d, "overall_tri", TRI_ORD, [Numeric("reply_time")] + COVARS)
    rows = complete_rows(d, fit.design, extra=["overall_tri"])
    stats = rows.agg(F.min("reply_time").alias("lo"), F.max("reply_time").alias("hi"),
                     *[F.avg(e).alias(f"m{i}") for i, e in enumerate(fit.design.exprs)]).first()
    means = np.array([stats[f"m{i}"] for i in range(fit.design.p)])
    other = float(fit.beta[1:] @ means[1:])
    grid = spark.range(20).select(
        (F.lit(float(stats["lo"])) + F.col("id").cast("double") * F.lit((stats["hi"] - stats["lo"]) / 19.0))
        .alias("reply_time"))
    eta = F.lit(float(fit.beta[0])) * F.col("reply_time") + F.lit(other)
    cdf = [F.lit(0.0)] + [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(z)) - eta))) for z in fit.zeta] \
        + [F.lit(1.0)]
    return grid.select(F.round("reply_time", 6).alias("reply_time"),
                       *[F.round(cdf[k + 1] - cdf[k], 6).alias(f"p_{lv.replace(' ', '_')}") for k, lv in enumerate(TRI_ORD)])


# --------------------------------------------------------------------- trees

def _item_features(d):
    """Questionnaire items as tree features: ordered scales by rank, yes/no as 0/1."""
    return [
        R.ordered_rank("q22", tuple(reversed(L.CLEAN_LEVELS))).cast("double").alias("clean"),
        R.ordered_rank("q32", L.CONFIDENCE_ORDERED).cast("double").alias("doctors"),
        R.ordered_rank("q36", L.CONFIDENCE_ORDERED).cast("double").alias("nurses"),
        R.ordered_rank("q49", L.CALL_BUTTON_ORDERED).cast("double").alias("call_button"),
        R.ordered_rank("q72", L.CONFIDENCE_ORDERED).cast("double").alias("dignity"),
        (F.col("emergency") == "yes").cast("double").alias("emergency"),
        (F.col("choice") == "Yes").cast("double").alias("choice"),
    ]


@query("regression_tree")
def regression_tree(spark, sf_dir):
    """Regression tree of the rating code on the questionnaire items; fitted value of every rated row."""
    d = derived(spark, sf_dir)
    names = ["clean", "doctors", "nurses", "call_button", "dignity", "emergency", "choice"]
    # an unanswered item is a value of its own below all answers, so the tree can send it either way
    rows = d.where(F.col("overall_sat").isNotNull()).select(
        "record", F.col("overall_sat").cast("double").alias("y"),
        *[F.coalesce(c, F.lit(-1.0)).alias(n) for n, c in zip(names, _item_features(d))])
    fit = fit_regression_tree(rows, "y", {n: F.col(n) for n in names})
    return rows.select("record", fit.fitted().alias("fitted"))


def _rank(col: str, levels) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{lv}' THEN {k}" for k, lv in enumerate(levels, 1)) + " END"


#: Features of the tree of the reply time, as SQL that both engines read.
_REPLY_FEATURES = {"strata": _rank("reply_strata", L.STRATA_LEVELS), "rating": "overall_sat",
                   "age": _rank("age_group", L.AGE_LEVELS), "los": "los", "emergency": _rank("emergency", ("no", "yes"))}


def _reply_tree(spark, sf_dir, cp: float, folds: int | None = None):
    """Rows with a reply time, and the tree of it."""
    rows = derived(spark, sf_dir).where("reply_time > 0")
    fold = F.pmod(F.xxhash64("record"), F.lit(folds)) if folds else None
    return rows, fit_regression_tree(rows, "reply_time", {n: F.expr(e) for n, e in _REPLY_FEATURES.items()}, cp=cp,
                                     fold=fold, folds=folds or 1)


_CUT_SUMS = ("(SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv, sum(n) OVER (PARTITION BY f ORDER BY v) AS ln, "
             "sum(s) OVER (PARTITION BY f ORDER BY v) AS ls, sum(n) OVER (PARTITION BY f) AS tn, sum(s) OVER (PARTITION BY f) AS ts "
             "FROM tv) w")


@query("regression_tree_first_split", sql=with_derived(
    "SELECT CASE f " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_REPLY_FEATURES)) + " END AS feature, "
    "(v + nv) / 2 AS threshold, CAST(ln AS BIGINT) AS n_left, round(ls / ln, 8) AS mean_left, CAST(tn - ln AS BIGINT) AS n_right, "
    "round((ts - ls) / (tn - ln), 8) AS mean_right, round(gain / (SELECT sum(y * y) - sum(y) * sum(y) / count(*) FROM tr), 8) "
    "AS improvement FROM (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM " + _CUT_SUMS +
    " WHERE nv IS NOT NULL AND ln >= 7 AND tn - ln >= 7) c ORDER BY gain DESC, f, v LIMIT 1",
    "tr AS (SELECT CAST(reply_time AS DOUBLE) AS y, " + ", ".join(
        f"CAST({e} AS DOUBLE) AS x{k}" for k, e in enumerate(_REPLY_FEATURES.values())) + " FROM d WHERE reply_time > 0 AND "
    + " AND ".join(f"({e}) IS NOT NULL" for e in _REPLY_FEATURES.values()) + "), tv AS ("
    + " UNION ALL ".join(f"SELECT {k} AS f, x{k} AS v, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM tr GROUP BY x{k}"
                         for k in range(len(_REPLY_FEATURES))) + ")"))
def regression_tree_first_split(spark, sf_dir):
    """First split of the reply-time tree: feature, threshold, both sides, share of the sum of squares that it takes away."""
    fit = _reply_tree(spark, sf_dir, 0.01)[1]
    t = fit.table(spark, 0.0)
    root = t.where("node = 0").select(F.col("feature").alias("feature"), "threshold", F.col("sse").alias("all"))
    sides = t.where("parent = 0").agg(*[e for k, side in ((1, "left"), (2, "right")) for e in (
        F.max(F.when(F.col("node") == k, F.col("n"))).alias(f"n_{side}"),
        F.max(F.when(F.col("node") == k, F.col("mean"))).alias(f"mean_{side}"))], F.sum("sse").alias("both"))
    part = root.select("*", sides.select(F.struct("*").alias("b")).scalar().alias("b"))
    return part.select("feature", "threshold", "b.n_left", F.round("b.mean_left", 8).alias("mean_left"), "b.n_right",
                       F.round("b.mean_right", 8).alias("mean_right"),
                       F.round(1.0 - F.col("b.both") / F.col("all"), 8).alias("improvement"))


@query("regression_tree_sequence")
def regression_tree_sequence(spark, sf_dir):
    """Pruned trees of the reply time: complexity, splits, error and its tenfold cross-validation."""
    return rounded(_reply_tree(spark, sf_dir, 0.005, folds=10)[1].sequence(spark), 8)


@query("regression_tree_pruned")
def regression_tree_pruned(spark, sf_dir):
    """Reply-time tree pruned to the least cross-validated error; fitted value of every reply."""
    rows, fit = _reply_tree(spark, sf_dir, 0.005, folds=10)
    return rows.select("record", F.round(fit.fitted(fit.best_cp()), 8).alias("fitted"))


@query("classification_tree")
def classification_tree(spark, sf_dir):
    """Classification tree of the rating label on reply time, age, LOS and gender."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.classification import DecisionTreeClassifier
    d = derived(spark, sf_dir)
    des = build_design(d, [Numeric("reply_time"), AGE, Numeric("los"), GENDER], intercept=False)
    rows = complete_rows(d, des, extra=["q74"]).select(
        "record", "q74", *[e.alias(f"x{i}") for i, e in enumerate(des.exprs)])
    indexer = StringIndexer(inputCol="q74", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    vec = VectorAssembler(inputCols=[f"x{i}" for i in range(des.p)], outputCol="features").transform(
        indexer.transform(rows))
    model = DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=7, seed=7).fit(vec)
    lv = F.array(*[F.lit(x) for x in indexer.labels])
    return model.transform(vec).select("record", "q74",
                                       F.element_at(lv, F.col("prediction").cast("int") + 1).alias("predicted"))


# --------------------------------------------------------- variants by group

@query("lm_by_wave", sql=with_waves(
    "SELECT wave, round(regr_intercept(CAST(overall_sat AS DOUBLE), CAST(reply_time AS DOUBLE)), 6) AS intercept, "
    "round(regr_slope(CAST(overall_sat AS DOUBLE), CAST(reply_time AS DOUBLE)), 8) AS slope, "
    "CAST(regr_count(CAST(overall_sat AS DOUBLE), CAST(reply_time AS DOUBLE)) AS BIGINT) AS n "
    "FROM d WHERE reply_time > 0 GROUP BY wave"))
def lm_by_wave(spark, sf_dir):
    """Rating on reply time in each of four waves: one grouped pass (regr_* aggregates).

    Waves are unioned by name, derived with per-wave censoring, and the
    per-wave least-squares line comes from ``groupBy(wave)``.
    """
    d = derive_wave(all_waves(spark, sf_dir), censor_by=("wave",)).where(F.col("reply_time") > 0)
    y, x = F.col("overall_sat").cast("double"), F.col("reply_time").cast("double")
    return d.groupBy("wave").agg(F.round(F.regr_intercept(y, x), 6).alias("intercept"),
                                 F.round(F.regr_slope(y, x), 8).alias("slope"),
                                 F.regr_count(y, x).alias("n"))


def _by_mailing(fits) -> str:
    """The same tidy select of three fits, labelled by mailing."""
    return " UNION ALL ".join(f"({Q.tidy(pre).replace('SELECT term', f'SELECT {k} AS mailing, term')})" for k, pre in fits)


_MAILINGS = [(k, f"y{k}") for k in (1, 2, 3)]


@query("aft_loglogistic_by_mailing", sql=Q.with_fit(_by_mailing(_MAILINGS), [
    c for k, pre in _MAILINGS for c in [*Q.aft(pre, _AFT1, f"reply_time{k}", cluster="trustcode"), *Q.estimates(
        pre, Q.terms_of(_AFT1, "Log(scale)"), var="w")]]))
def aft_loglogistic_by_mailing(spark, sf_dir):
    """Log-logistic AFT of the time since each mailing (replies to that mailing only)."""
    d = joint(derived(spark, sf_dir), "trustcode", "overall_tri", "event", "reply_time1", "reply_time2", "reply_time3")
    fits = run_all([lambda k=k: _aft(spark, sf_dir, [TRI], time=f"reply_time{k}", data=d) for k in (1, 2, 3)])
    out = None
    for k, fit in zip((1, 2, 3), fits):
        t = tidy(fit.table(spark)).withColumn("mailing", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


@query("random_intercept_lmm_full")
def random_intercept_lmm_full(spark, sf_dir):
    """REML: reply time ~ satisfaction + covariates + choice + (1 | trust)."""
    return fit_lmm(derived(spark, sf_dir), "reply_time", FULL + [CHOICE], "trustcode").table(spark)


@query("random_intercept_lmm_log", sql=Q.with_fit(Q.TIDY_REML.format(pre="m"), Q.lmm_tri(
    "m", "CASE WHEN reply_time > 0 THEN ln(CAST(reply_time AS DOUBLE)) END")))
def random_intercept_lmm_log(spark, sf_dir):
    """REML: log reply time ~ satisfaction + (1 | trust)."""
    return tidy_reml(fit_lmm(derived(spark, sf_dir), "reply_time", [TRI], "trustcode", log_y=True).table(spark))


_LOGM = [Q.ONE, *Q.FULL, *Q.CHOICE]


@query("lm_log_by_mailing", sql=Q.with_fit(_by_mailing(_MAILINGS), [
    c for k, pre in _MAILINGS for c in [*Q.ols(
        pre, _LOGM, f"CASE WHEN reply_time{k} > 0 THEN ln(CAST(reply_time{k} AS DOUBLE)) END"), *Q.estimates(
        pre, Q.terms_of(_LOGM), f"(SELECT s2 FROM {pre}_q)", f"(SELECT n - {len(_LOGM)} FROM {pre}_q)")]]))
def lm_log_by_mailing(spark, sf_dir):
    """OLS of log time since each mailing on satisfaction and covariates."""
    d = derived(spark, sf_dir)
    fits = run_all([lambda k=k: fit_lm(d, f"reply_time{k}", FULL + [CHOICE], log_y=True) for k in (1, 2, 3)])
    out = None
    for k, fit in zip((1, 2, 3), fits):
        t = tidy(fit.table(spark)).withColumn("mailing", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


RATING_ALPHA = tuple(sorted(L.RATING_LEVELS))  # factor levels after a CSV round trip: Excellent first


_LRF_SQL = """
g AS (SELECT q74, count(*) AS n, avg(CAST(reply_time AS DOUBLE)) AS mean,
             sum(CAST(reply_time AS DOUBLE) * CAST(reply_time AS DOUBLE)) AS ss
      FROM d WHERE q74 IS NOT NULL AND reply_time IS NOT NULL GROUP BY q74),
tot AS (SELECT sum(ss - n * mean * mean) / (sum(n) - count(*)) AS s2 FROM g),
ref AS (SELECT n AS n0, mean AS m0 FROM g WHERE q74 = 'Excellent'),
est AS (
  SELECT '(Intercept)' AS term, m0 AS estimate, sqrt(s2 / n0) AS std_error FROM ref, tot
  UNION ALL
  SELECT 'q74' || q74, mean - m0, sqrt(s2 * (1.0 / n + 1.0 / n0)) FROM g, ref, tot WHERE q74 <> 'Excellent'
)"""


@query("lm_rating_factor", sql=with_derived(
    "SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error FROM est", _LRF_SQL))
def lm_rating_factor(spark, sf_dir):
    """OLS of reply time on the five-level rating as a factor (level means vs Excellent)."""
    fit = fit_lm(derived(spark, sf_dir), "reply_time", [Factor("q74", RATING_ALPHA)])
    return fit.table(spark).select("term", F.round("estimate", 6).alias("estimate"),
                                   F.round("std_error", 6).alias("std_error"))


_DIGN = [Q.ONE, *Q.TIME, *Q.EMERG, *Q.CHOICE, *Q.AGE,
         ("log(los)", "CASE WHEN los > 0 THEN ln(CAST(los AS DOUBLE)) END", "nullif(greatest(los, 0), 0)"), *Q.GENDER]


@query("logit_dignity", sql=Q.with_fit(Q.tidy("m"), [*Q.logit(
    "m", _DIGN, "CASE WHEN q72 IS NULL THEN NULL WHEN q72 = 'Yes, always' THEN 'Always' ELSE 'Sometimes or no' END",
    "Sometimes or no", "reply_time > 0"), *Q.estimates("m", Q.terms_of(_DIGN))]))
def logit_dignity(spark, sf_dir):
    """Logit of 'Sometimes or no' dignity on reply time + covariates (reply time > 0)."""
    d = derived(spark, sf_dir).withColumn("dignity", R.dignity("q72")).where(F.col("reply_time") > 0)
    fit = fit_logit(d, "dignity", "Sometimes or no", [Numeric("reply_time"), EMERG, CHOICE, AGE,
                                                      Numeric("los", log=True), GENDER])
    return tidy(fit.table(spark))


_RATE = [*Q.TIME, *Q.AGE, ("los", "CAST(los AS DOUBLE)", "los"), *Q.GENDER]


@query("ordinal_logit_rating", sql=Q.with_fit(Q.tidy("m"), [*Q.ordinal(
    "m", _RATE, "CAST(overall_sat AS VARCHAR)", list("12345"), "reply_time > 0"), *Q.estimates(
    "m", Q.terms_of(_RATE, *_cuts("12345")))]))
def ordinal_logit_rating(spark, sf_dir):
    """Proportional odds of the five-point rating code on reply time, age, LOS, gender."""
    d = derived(spark, sf_dir).where(F.col("reply_time") > 0).withColumn(
        "rating_code", F.col("overall_sat").cast("string"))
    fit = fit_ordinal(d, "rating_code", ("1", "2", "3", "4", "5"),
                      [Numeric("reply_time"), AGE, Numeric("los"), GENDER])
    return tidy(fit.table(spark))


_TIMES = {"all": "reply_time", "mail1": "reply_time1", "mail2": "reply_time2", "mail3": "reply_time3"}


def _aft_predictions(design: list, rows: str) -> str:
    return Q.with_fit(" UNION ALL ".join(
        f"SELECT overall_tri, '{n}' AS model, round(exp({Q.linear(f't{k}', design)}), 6) AS predicted_time FROM {rows}"
        for k, n in enumerate(_TIMES)), [c for k, t in enumerate(_TIMES.values()) for c in Q.aft(f"t{k}", design, t)])


@query("predict_aft_full_by_mailing", sql=_aft_predictions(_AFTF, _PROFILES))
def predict_aft_full_by_mailing(spark, sf_dir):
    """Predicted reply time at the study's profiles from the full AFT: all replies and each mailing."""
    d = joint(derived(spark, sf_dir), "event", *_TIMES.values(), *_COVAR_COLS)
    fits = run_all([lambda t=t: A.fit_loglogistic(d, t, "event", FULL, count="n_rows") for t in _TIMES.values()])
    prof = _tri_profiles(spark, PROFILE)
    out = None
    for name, fit in zip(_TIMES, fits):
        t = prof.select("overall_tri", F.lit(name).alias("model"), F.round(F.exp(fit.linear_score()), 6).alias("predicted_time"))
        out = t if out is None else out.unionByName(t)
    return out


@query("predict_aft_by_mailing", sql=_aft_predictions(_AFT1, _TRI_ROWS))
def predict_aft_by_mailing(spark, sf_dir):
    """Predicted reply time by satisfaction from the one-factor AFT: all replies and each mailing."""
    d = joint(derived(spark, sf_dir), "trustcode", "overall_tri", "event", "reply_time", "reply_time1", "reply_time2", "reply_time3")
    times = {"all": "reply_time", "mail1": "reply_time1", "mail2": "reply_time2", "mail3": "reply_time3"}
    fits = run_all([lambda t=t: _aft(spark, sf_dir, [TRI], time=t, data=d) for t in times.values()])
    prof = _tri_profiles(spark)
    out = None
    for name, fit in zip(times, fits):
        t = prof.select("overall_tri", F.lit(name).alias("model"), F.round(F.exp(fit.linear_score()), 6).alias("predicted_time"))
        out = t if out is None else out.unionByName(t)
    return out


@query("cox_ph_full")
def cox_ph_full(spark, sf_dir):
    """Cox model (Efron ties) with satisfaction, emergency, choice, age, log LOS and gender; robust SE by trust."""
    fit = CX.fit_cox(derived(spark, sf_dir), "reply_time", "event", FULL + [CHOICE], cluster="trustcode")
    return fit.table(spark, robust=True)


@query("fitted_values_single_factor", sql=with_derived(
    "SELECT d.record, round(g.p, 8) AS fitted FROM d JOIN (SELECT overall_tri, "
    "CAST(sum(CASE WHEN rep_mail = 'Repeated' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p FROM d "
    "WHERE overall_tri IS NOT NULL AND rep_mail IS NOT NULL GROUP BY overall_tri) g ON d.overall_tri = g.overall_tri "
    "WHERE d.rep_mail IS NOT NULL"))
def fitted_values_single_factor(spark, sf_dir):
    """Fitted P(repeated mailing) per training row of the one-factor logit (= the group share)."""
    d = derived(spark, sf_dir)
    fit = fit_logit(d, "rep_mail", "Repeated", [TRI])
    rows = complete_rows(d, fit.design, extra=["rep_mail"])
    return rows.select("record", F.round(inv_logit(fit.linear_score()), 8).alias("fitted"))


@query("odds_ratio_single_factor", sql=with_derived(
    "SELECT term, round(exp(estimate), 6) AS odds_ratio, round(exp(estimate) * std_error, 6) AS std_error FROM est",
    _LOGIT1_SQL))
def odds_ratio_single_factor(spark, sf_dir):
    """exp(coefficients) of the one-factor logit of a repeated mailing, delta-method SE."""
    fit = fit_logit(derived(spark, sf_dir), "rep_mail", "Repeated", [TRI])
    orr, se = odds_ratio_rows(fit)
    rows = [(n, float(o), float(s)) for n, o, s in zip(fit.design.names, orr, se)]
    out = spark.createDataFrame(rows, "term string, odds_ratio double, std_error double")
    return out.select("term", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("std_error", 6).alias("std_error"))


@query("random_intercept_lmm_by_mailing", sql=Q.with_fit(" UNION ALL ".join(
    f"({Q.TIDY_REML.format(pre=pre).replace('SELECT term', f'SELECT {k} AS mailing, term')})" for k, pre in _MAILINGS),
    [c for k, pre in _MAILINGS for c in Q.lmm_tri(pre, f"CAST(reply_time{k} AS DOUBLE)")]))
def random_intercept_lmm_by_mailing(spark, sf_dir):
    """REML: time since each mailing ~ satisfaction + (1 | trust), replies to that mailing."""
    d = derived(spark, sf_dir)
    fits = run_all([lambda k=k: fit_lmm(d, f"reply_time{k}", [TRI], "trustcode") for k in (1, 2, 3)])
    out = None
    for k, fit in zip((1, 2, 3), fits):
        t = tidy_reml(fit.table(spark)).withColumn("mailing", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


_STATS_SQL = """
SELECT 'lm_multi' AS model, 'n' AS statistic, round(n, 5) AS value FROM m_q
UNION ALL SELECT 'lm_multi', 'df_residual', n - {p} FROM m_q
UNION ALL SELECT 'lm_multi', 'residual_sd', round(sqrt(s2), 5) FROM m_q
UNION ALL SELECT 'lm_multi', 'r_squared', round(1 - s2 * (n - {p}) / tss, 5) FROM m_q, tot
UNION ALL SELECT 'lm_multi', 'f_statistic', round((tss - s2 * (n - {p})) / ({p} - 1) / s2, 4) FROM m_q, tot
UNION ALL SELECT 'logit', 'n', round(n, 5) FROM ll
UNION ALL SELECT 'logit', 'log_likelihood', round(v, 4) FROM ll
UNION ALL SELECT 'logit', 'deviance', round(-2 * v, 4) FROM ll"""


@query("fit_statistics", sql=Q.with_fit(_STATS_SQL.format(p=len(_MULTI)), [
    *_MULTI_FIT, "tot AS (SELECT sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) AS tss FROM m_s)",
    *Q.logit("l", _LOGIT, "early", "Late"),
    "ll AS (SELECT sum(s.w) AS n, sum(s.w * (s.y * e.eta - ln(1 + exp(e.eta)))) AS v FROM l_s s JOIN (SELECT x.rid, "
    "sum(x.x * b.b) AS eta FROM l_x x JOIN l_b b USING (i) GROUP BY x.rid) e USING (rid))"]))
def fit_statistics(spark, sf_dir):
    """Rows, residual spread, R squared and F of the full OLS; rows, log-likelihood and deviance of the logit."""
    d = derived(spark, sf_dir).withColumn("overall_score", R.satisfaction_score("overall_sat"))
    lm = fit_lm(d, "reply_time", [Factor("overall_score", (0, 25, 50, 75, 100)), EMERG, CHOICE, AGE, LOGLOS, GENDER])
    lg = fit_logit(d, "early", "Late", FULL + [CHOICE])
    p = len(lm.beta)
    f = lm.r2 / (1.0 - lm.r2) * lm.df_resid / (p - 1)
    rows = [("lm_multi", "n", lm.n), ("lm_multi", "df_residual", lm.df_resid), ("lm_multi", "residual_sd", round(lm.sigma, 5)),
            ("lm_multi", "r_squared", round(lm.r2, 5)), ("lm_multi", "f_statistic", round(f, 4)), ("logit", "n", lg.n),
            ("logit", "log_likelihood", round(lg.loglik, 4)), ("logit", "deviance", round(lg.deviance, 4))]
    rows = [(m, s, float(v)) for m, s, v in rows]
    return spark.createDataFrame(rows, "model string, statistic string, value double")
