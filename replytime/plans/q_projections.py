"""Projection, recode and filter queries (sections 2.2 and 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import levels as L
from ..functions import core as C
from ..functions import recode as R
from ..operators import filters as FL
from ..operators.derive import (drop_missing_level, ordinal_code, reply_time_coalesced,
                                with_ordered_outcomes)
from .common import derived, four_waves, raw
from .oracle_base import with_derived, with_waves
from .registry import query, rounded


def _proj(name, spark_cols, sql_cols, doc, where=None, sql_where=None, digits=8):
    """Register a row-level projection of the derived table."""
    sql = with_derived(f"SELECT record, {sql_cols} FROM d" + (f" WHERE {sql_where}" if sql_where else ""))

    def fn(spark, sf_dir):
        d = derived(spark, sf_dir)
        if where is not None:
            d = d.where(where())
        return rounded(d.select("record", *spark_cols()), digits)

    fn.__doc__ = doc
    fn.__name__ = name
    query(name, sql=sql)(fn)


_proj("spss_to_date", lambda: ["date_rec", "mail1", "mail2", "mail3"],
      "date_rec, mail1, mail2, mail3", "SPSS seconds to calendar dates.")

_proj("reply_days", lambda: [C.reply_days("date_rec", "mail1").alias("reply_days"),
                             C.reply_days("new_date_rec", "mail1").alias("reply_days_censored")],
      "CAST(date_rec - mail1 AS INTEGER) AS reply_days, CAST(new_date_rec - mail1 AS INTEGER) AS reply_days_censored",
      "Whole days from first mailing to receipt (raw and with censoring date).")

_proj("nonpositive_to_null",
      lambda: [C.nonpositive_to_null(C.reply_days("date_rec", "mail1"), 0, True).alias("time_pos"),
               C.nonpositive_to_null(C.reply_days("date_rec", "mail1"), 0, False).alias("time_nonneg")],
      "CASE WHEN date_rec - mail1 <= 0 THEN NULL ELSE CAST(date_rec - mail1 AS INTEGER) END AS time_pos, "
      "CASE WHEN date_rec - mail1 < 0 THEN NULL ELSE CAST(date_rec - mail1 AS INTEGER) END AS time_nonneg",
      "Impossible reply times to NULL: at or below 0, or strictly below 0.")

_proj("outcome_class", lambda: ["outcome", "new_outcome"], "outcome, new_outcome",
      "Outcome label to Returned / Not returned / NULL.")

_proj("event_flag", lambda: ["event", R.event_flag_wave("outcome").alias("event_any")],
      "event, CASE WHEN outcome = 'Returned useable questionnaire' THEN 1 ELSE 0 END AS event_any",
      "Event indicator (1 returned, 0 censored, NULL other) and the all-else-0 variant.")

_proj("censor_date", lambda: ["new_outcome", "date_rec", "max_date", "new_date_rec"],
      "new_outcome, date_rec, max_date, new_date_rec",
      "Non-returns take the last received date as censoring date.")

_proj("reply_strata",
      lambda: ["reply_strata", R.reply_strata("date_rec", "mail2", "mail3").alias("reply_strata_dates")],
      "reply_strata, CASE WHEN date_rec <= mail2 THEN 'Mail1' WHEN date_rec IS NULL OR mail2 IS NULL THEN NULL "
      "WHEN (date_rec <= mail3 AND date_rec > mail2) THEN 'Mail2' "
      "WHEN (date_rec <= mail3 AND date_rec > mail2) IS NULL THEN NULL "
      "WHEN date_rec > mail3 THEN 'Mail3' END AS reply_strata_dates",
      "Mailing that produced the reply (with and without the outcome condition).")

_proj("reply_time_by_mailing", lambda: ["reply_time", "reply_time1", "reply_time2", "reply_time3"],
      "reply_time, reply_time1, reply_time2, reply_time3",
      "Reply time since first mailing, and since each mailing for its own stratum.")

_MAIL_MAP = dict(zip(L.STRATA_LEVELS, L.MAILING_LABELS))

_proj("reply_time_coalesced",
      lambda: [reply_time_coalesced().alias("rep_time"), R.relabel("reply_strata", _MAIL_MAP).alias("mailing")],
      "CASE WHEN reply_strata = 'Mail1' THEN reply_time1 WHEN reply_strata = 'Mail2' THEN reply_time2 "
      "WHEN reply_strata = 'Mail3' THEN reply_time3 END AS rep_time, "
      "CASE reply_strata WHEN 'Mail1' THEN 'First' WHEN 'Mail2' THEN 'Second' WHEN 'Mail3' THEN 'Third' END AS mailing",
      "Time since the mailing that triggered the reply, with the mailing relabelled.")

_proj("mailing_gap", lambda: [C.reply_days("mail2", "mail1").alias("gap2"),
                              C.reply_days("mail3", "mail1").alias("gap3")],
      "CAST(mail2 - mail1 AS INTEGER) AS gap2, CAST(mail3 - mail1 AS INTEGER) AS gap3",
      "Reminder lags in days.")

_proj("repeat_mail_flag", lambda: ["reply_strata", "rep_mail"], "reply_strata, rep_mail",
      "First vs Repeated mailing.")

_proj("early_late_flag", lambda: ["early", "late", "late1", "late2", "late3", "reply_strata2"],
      "early, late, late1, late2, late3, reply_strata2",
      "Early (<= 14 days) / Late flags and 21-day flags for all and each mailing.")

_proj("satisfaction_tri", lambda: ["overall_sat", "overall_tri"], "overall_sat, overall_tri",
      "Five-point rating to Excellent / Very good / Other.")

_proj("satisfaction_binary", lambda: [R.satisfaction_binary("overall_sat").alias("overall_dic")],
      "CASE WHEN overall_sat IS NULL THEN NULL WHEN overall_sat < 4 THEN 'Good' ELSE 'Poor.Fair' END AS overall_dic",
      "Good (code < 4) vs Poor.Fair.")

_proj("satisfaction_score", lambda: [R.satisfaction_score("overall_sat").alias("overall_score")],
      "CASE WHEN overall_sat IS NULL THEN NULL WHEN overall_sat = 1 THEN 100 WHEN overall_sat = 2 THEN 75 "
      "WHEN overall_sat = 3 THEN 50 WHEN overall_sat = 4 THEN 25 ELSE 0 END AS overall_score",
      "Rating code to 100 / 75 / 50 / 25 / 0.")

_proj("recode_covariates", lambda: ["emergency", "choice", R.dignity("q72").alias("dignity")],
      "emergency, choice, CASE WHEN q72 IS NULL THEN NULL WHEN q72 = 'Yes, always' THEN 'Always' "
      "ELSE 'Sometimes or no' END AS dignity",
      "Emergency admission, choice of date, treated with dignity.")


@query("recode_covariates_2006", sql=with_waves(
    "SELECT record, CASE WHEN q6 IS NULL THEN NULL WHEN q6 = 'No, but I would have liked a choice' THEN 'No' ELSE 'Other' END AS choice, "
    "CASE WHEN q72 IS NULL THEN NULL WHEN q72 = 'Yes, always' THEN 'Always' ELSE 'Sometimes or no' END AS dignity "
    "FROM inpatient4 WHERE wave = 2006"))
def recode_covariates_2006(spark, sf_dir):
    """The 2006 wave under its own names: choice of hospital from q6, treated with dignity from q64."""
    wave = four_waves(spark, sf_dir)[2006]
    return wave.select("record", R.choice_q6("q6").alias("choice"), R.dignity("q64").alias("dignity"))


_proj("los_transform",
      lambda: ["los", C.floor_los("los").alias("los_floor"), "log_los",
               C.los_transform("los", floor_at_one=False).alias("log_los_raw")],
      "los, CASE WHEN los IS NULL THEN NULL WHEN los < 1 THEN 1 ELSE los END AS los_floor, "
      "round(log_los, 8) AS log_los, round(CASE WHEN los > 0 THEN ln(CAST(los AS DOUBLE)) END, 8) AS log_los_raw",
      "Length of stay floored at one day and logged; unfloored log is NULL at 0.")

_proj("log_reply_time", lambda: [C.safe_ln("reply_time").alias("log_reply_time")],
      "round(CASE WHEN reply_time > 0 THEN ln(CAST(reply_time AS DOUBLE)) END, 8) AS log_reply_time",
      "Log of positive reply time.")

_proj("composite_key", lambda: [C.composite_key("trustcode", "record").alias("pid")],
      "trustcode || '.' || CAST(record AS VARCHAR) AS pid", "Trust.record identifier.")

_proj("inv_logit",
      lambda: [C.inv_logit((F.col("reply_time") - 21) / 7.0).alias("p"),
               C.inv_logit((F.col("reply_time") - 21) / 7.0, 1.0, 5.0).alias("p_scaled")],
      "round(1.0 / (1.0 + exp(-((reply_time - 21) / 7.0))), 8) AS p, "
      "round(1.0 / (1.0 + exp(-((reply_time - 21) / 7.0))) * 4.0 + 1.0, 8) AS p_scaled",
      "Logistic transform (with min/max scaling) of a centred reply time.")

_proj("attach_columns", lambda: ["reply_time", "overall_sat", F.col("all_gender").alias("sex")],
      "reply_time, overall_sat, all_gender AS sex", "Derived columns attached, one column renamed.")

_proj("relabel_levels",
      lambda: [R.relabel("reply_strata", _MAIL_MAP).alias("mailing"),
               R.relabel("reply_strata", {"Mail1": "First", "Mail2": "Repeated", "Mail3": "Repeated"}).alias("rep_mail2")],
      "CASE reply_strata WHEN 'Mail1' THEN 'First' WHEN 'Mail2' THEN 'Second' WHEN 'Mail3' THEN 'Third' END AS mailing, "
      "CASE reply_strata WHEN 'Mail1' THEN 'First' WHEN 'Mail2' THEN 'Repeated' WHEN 'Mail3' THEN 'Repeated' END AS rep_mail2",
      "Rename levels by a dictionary.")


@query("ordinal_code", sql=with_derived(
    "SELECT record, q74, code AS q74_code FROM d LEFT JOIN "
    "(SELECT level, CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS code FROM rating_dict "
    " WHERE level IN (SELECT q74 FROM d)) u ON d.q74 = u.level"))
def ordinal_code_q(spark, sf_dir):
    """Rating codes 1..k over the levels that occur, in dictionary order."""
    r = raw(spark, sf_dir)
    return ordinal_code(r, "q74", L.RATING_LEVELS, "q74_code").select("record", "q74", "q74_code")


@query("drop_missing_level", sql=with_derived(
    "SELECT all_gender, gender, count(*) AS n FROM d GROUP BY all_gender, gender"))
def drop_missing_level_q(spark, sf_dir):
    """'Missing data' gender becomes NULL; counts per original and new level."""
    r = raw(spark, sf_dir)
    return r.select("all_gender", drop_missing_level("all_gender").alias("gender")).groupBy(
        "all_gender", "gender").agg(F.count(F.lit(1)).alias("n"))


_ORD_SQL = (
    "CASE WHEN q22 = 'Very clean' THEN 'Very clean' WHEN q22 = 'Fairly clean' THEN 'Fairly clean' "
    "WHEN q22 IS NULL THEN NULL ELSE 'Other' END AS clean_tri, "
    "CASE WHEN q22 = 'Very clean' THEN 3 WHEN q22 = 'Fairly clean' THEN 2 WHEN q22 IS NULL THEN NULL ELSE 1 END AS clean_rank, "
    "q32 AS doc_conf, CASE q32 WHEN 'No' THEN 1 WHEN 'Yes, sometimes' THEN 2 WHEN 'Yes, always' THEN 3 END AS doc_rank, "
    "q36 AS nurse_conf, CASE q36 WHEN 'No' THEN 1 WHEN 'Yes, sometimes' THEN 2 WHEN 'Yes, always' THEN 3 END AS nurse_rank, "
    "q49 AS call_but, CASE q49 WHEN 'I never got help when I used the call button ' THEN 1 "
    "WHEN 'More than 5 minutes' THEN 2 WHEN '3-5 minutes' THEN 3 WHEN '1-2 minutes' THEN 4 "
    "WHEN '0 minutes/ right away' THEN 5 END AS call_rank")


@query("ordered_recode", sql=with_derived(f"SELECT record, {_ORD_SQL} FROM d"))
def ordered_recode(spark, sf_dir):
    """Ordered scales: cleanliness collapsed to three levels, doctors, nurses, call button."""
    d = with_ordered_outcomes(derived(spark, sf_dir))
    return d.select(
        "record", "clean_tri", R.ordered_rank("clean_tri", L.CLEAN_TRI_ORDERED).alias("clean_rank"),
        "doc_conf", R.ordered_rank("doc_conf", L.CONFIDENCE_ORDERED).alias("doc_rank"),
        "nurse_conf", R.ordered_rank("nurse_conf", L.CONFIDENCE_ORDERED).alias("nurse_rank"),
        "call_but", R.ordered_rank("call_but", L.CALL_BUTTON_ORDERED).alias("call_rank"))


_HELPERS = ("mailing1", "mailing2", "mailing3", "daterec", "max_date", "new_date_rec")


@query("drop_columns", sql=with_derived(
    f"SELECT * EXCLUDE ({', '.join(_HELPERS)}, log_los), round(log_los, 8) AS log_los FROM d"))
def drop_columns(spark, sf_dir):
    """The analysis table without its helper columns."""
    return rounded(derived(spark, sf_dir).drop(*_HELPERS), 8)


# ---------------------------------------------------------------- filters (2.3)

_proj("filter_positive_reply", lambda: ["reply_time", "overall_sat"], "reply_time, overall_sat",
      "Rows with a strictly positive reply time.", where=lambda: F.col("reply_time") > 0,
      sql_where="reply_time > 0")

_CC = ("reply_time", "event", "overall_tri", "emergency", "age_group", "log_los", "gender")


@query("complete_cases", sql=with_derived(
    f"SELECT record, {', '.join(c for c in _CC if c != 'log_los')}, round(log_los, 8) AS log_los FROM d WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _CC)))
def complete_cases(spark, sf_dir):
    """Rows with no missing value among the model columns."""
    d = derived(spark, sf_dir).select("record", *_CC)
    return rounded(FL.complete_cases(d, _CC), 8)


@query("trust_rows", sql=with_derived(
    "SELECT reply_time, mail1, date_rec FROM d WHERE trustcode = 'T7'"))
def trust_rows(spark, sf_dir):
    """Rows of one trust with chosen columns."""
    return FL.trust_rows(derived(spark, sf_dir), "T7", ["reply_time", "mail1", "date_rec"])


@query("list_sample", sql=with_derived(
    "SELECT trustcode, record, date_rec, new_date_rec, new_outcome, outcome, overall_sat FROM d "
    "ORDER BY trustcode, record LIMIT 50"))
def list_sample(spark, sf_dir):
    """First 50 rows by (trust, record), five columns."""
    return FL.list_sample(derived(spark, sf_dir),
                          ["date_rec", "new_date_rec", "new_outcome", "outcome", "overall_sat"], 50)


_proj("non_null_group", lambda: ["overall_tri", "reply_time"], "overall_tri, reply_time",
      "Rows with a satisfaction group.", where=lambda: F.col("overall_tri").isNotNull(),
      sql_where="overall_tri IS NOT NULL")


@query("time_range", sql=with_derived(
    "SELECT record, mailing, rep_time FROM (SELECT record, "
    "CASE reply_strata WHEN 'Mail1' THEN 'First' WHEN 'Mail2' THEN 'Second' WHEN 'Mail3' THEN 'Third' END AS mailing, "
    "CASE WHEN reply_strata = 'Mail1' THEN reply_time1 WHEN reply_strata = 'Mail2' THEN reply_time2 "
    "WHEN reply_strata = 'Mail3' THEN reply_time3 END AS rep_time FROM d) x WHERE rep_time BETWEEN 0 AND 40"))
def time_range(spark, sf_dir):
    """Per-mailing reply times clipped to 0-40 days."""
    d = derived(spark, sf_dir).select(
        "record", R.relabel("reply_strata", _MAIL_MAP).alias("mailing"), reply_time_coalesced().alias("rep_time"))
    return FL.time_range(d, "rep_time", 0, 40)


@query("censor_date_by_trust", sql=with_derived(
    "SELECT d.record, d.trustcode, d.new_outcome, t.max_date, "
    "CASE WHEN d.new_outcome IS NULL THEN NULL WHEN d.new_outcome = 'Not returned' THEN t.max_date "
    "ELSE d.date_rec END AS new_date_rec FROM d JOIN "
    "(SELECT trustcode, max(date_rec) AS max_date FROM d GROUP BY trustcode) t ON d.trustcode = t.trustcode"))
def censor_date_by_trust(spark, sf_dir):
    """Non-returns censored at their own trust's last received date."""
    from ..operators.derive import derive_wave
    d = derive_wave(raw(spark, sf_dir), censor_by=("trustcode",))
    return d.select("record", "trustcode", "new_outcome", "max_date", "new_date_rec")
