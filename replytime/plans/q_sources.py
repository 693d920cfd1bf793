"""Source / sink and join queries (sections 2.1 and 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import joins as J
from ..operators import survival as S
from ..operators.derive import derive_wave
from ..sources import scan
from ..sources.fixture import inpatient_path
from .common import all_waves, derived, raw
from .oracle_base import DERIVED_SQL, km_sql, with_derived, with_waves
from .registry import query, rounded

_RAW_COLS = [f.name for f in scan.SURVEY_SCHEMA.fields]


@query("survey_scan", sql=f"WITH {DERIVED_SQL} SELECT {', '.join(_RAW_COLS)} FROM inpatient")
def survey_scan(spark, sf_dir):
    """The stored Parquet wave loaded with the fixed survey schema (no inference)."""
    return scan.survey_scan(spark, inpatient_path(spark, sf_dir))


_CSV_COPIES: dict = {}


@query("csv_scan", sql=f"WITH {DERIVED_SQL} SELECT {', '.join(_RAW_COLS)} FROM inpatient")
def csv_scan(spark, sf_dir):
    """The wave as CSV (NA for missing; written once per session) read with an explicit schema."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _CSV_COPIES.get(key)
    if path is None:
        path = scan.scratch_path(spark, "wave2009-csv")
        scan.csv_write(raw(spark, sf_dir), path)
        _CSV_COPIES[key] = path
    return scan.csv_scan(spark, path, scan.SURVEY_SCHEMA)


_RT_COLS = ("trustcode", "record", "date_rec", "new_date_rec", "reply_strata", "reply_time",
            "reply_time1", "reply_time2", "reply_time3", "event", "overall_tri", "log_los", "gender")


@query("csv_roundtrip", sql=with_derived(f"SELECT {', '.join(_RT_COLS[:-2])}, round(log_los, 8) AS log_los, gender FROM d"))
def csv_roundtrip(spark, sf_dir):
    """Derived table written to CSV and reloaded with its schema (levels kept)."""
    d = derived(spark, sf_dir).select(*_RT_COLS)
    back = scan.csv_roundtrip(spark, d)
    return rounded(back, 8)


@query("wave_union", sql=with_waves("SELECT * FROM inpatient4"))
def wave_union(spark, sf_dir):
    """Four waves under their own column names, renamed by config and unioned by name."""
    return all_waves(spark, sf_dir)


@query("select_columns", sql=f"WITH {DERIVED_SQL} SELECT record, q1, q10, q22, q32, q36, q49, q72, q74, "
       "outcome, mailing1, mailing2, mailing3, daterec FROM inpatient")
def select_columns(spark, sf_dir):
    """Projection by a built list of question names plus the time variables."""
    return scan.select_columns(raw(spark, sf_dir), (1, 10, 22, 32, 36, 49, 72, 74),
                               extra=("record", "outcome", "mailing1", "mailing2", "mailing3", "daterec"))


@query("attach_response_rate", sql=with_derived(
    "SELECT d.record, d.trustcode, round(r.response_rate, 8) AS response_rate FROM d LEFT JOIN "
    "(SELECT trustcode, CAST(count(overall_sat) AS DOUBLE) / count(*) AS response_rate FROM d GROUP BY trustcode) r "
    "ON d.trustcode = r.trustcode"))
def attach_response_rate(spark, sf_dir):
    """Per-trust response rate joined to every row."""
    d = derived(spark, sf_dir)
    rates = J.response_rate_by_trust(d)
    return rounded(J.attach_response_rate(d.select("record", "trustcode"), rates), 8)


_ALIGN_EXTRA = """
curves_in AS (
  SELECT 'all' AS curve, CAST(reply_time AS DOUBLE) AS time, event FROM d WHERE reply_time IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail1', CAST(reply_time1 AS DOUBLE), event FROM d WHERE reply_time1 IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail2', CAST(reply_time2 AS DOUBLE), event FROM d WHERE reply_time2 IS NOT NULL AND event IS NOT NULL
  UNION ALL SELECT 'mail3', CAST(reply_time3 AS DOUBLE), event FROM d WHERE reply_time3 IS NOT NULL AND event IS NOT NULL
),""" + km_sql("curves_in", "curve")


@query("km_curves_aligned", sql=with_derived(
    "SELECT coalesce(a.time, b.time, c.time, e.time) AS time, round(1 - a.surv, 8) AS response_rate, "
    "round(1 - b.surv, 8) AS response_rate1, round(1 - c.surv, 8) AS response_rate2, "
    "round(1 - e.surv, 8) AS response_rate3 FROM "
    "(SELECT time, surv FROM km WHERE curve = 'all') a "
    "FULL JOIN (SELECT time, surv FROM km WHERE curve = 'mail1') b ON a.time = b.time "
    "FULL JOIN (SELECT time, surv FROM km WHERE curve = 'mail2') c ON coalesce(a.time, b.time) = c.time "
    "FULL JOIN (SELECT time, surv FROM km WHERE curve = 'mail3') e ON coalesce(a.time, b.time, c.time) = e.time",
    _ALIGN_EXTRA))
def km_curves_aligned(spark, sf_dir):
    """Overall and per-mailing response curves on one time axis (one scan, pivot on time)."""
    d = derived(spark, sf_dir)
    pairs = S.stack_curves(d, {"all": "reply_time", "mail1": "reply_time1", "mail2": "reply_time2",
                               "mail3": "reply_time3"})
    km = S.response_curve(S.kaplan_meier(pairs, by=("curve",), conf=False))
    names = {"all": "response_rate", "mail1": "response_rate1", "mail2": "response_rate2",
             "mail3": "response_rate3"}
    return rounded(S.align_curves_long(km, names), 8)


@query("wave_subset_join", sql=with_derived(
    "SELECT d.trustcode || '.' || CAST(d.record AS VARCHAR) AS pid, d.reply_time, d.overall_sat, s.q22, s.q49 "
    "FROM d JOIN (SELECT trustcode || '.' || CAST(record AS VARCHAR) AS pid, q22, q49 FROM inpatient "
    "WHERE outcome = 'Returned useable questionnaire' AND q74 IS NOT NULL) s "
    "ON d.trustcode || '.' || CAST(d.record AS VARCHAR) = s.pid"))
def wave_subset_join(spark, sf_dir):
    """Inner join of the wave to a scored subset on the composite id trust.record."""
    r = raw(spark, sf_dir)
    subset = r.where((F.col("outcome") == "Returned useable questionnaire")
                     & F.col("q74").isNotNull()).select("trustcode", "record", "q22", "q49")
    d = derive_wave(r).select("trustcode", "record", "reply_time", "overall_sat")
    return J.wave_subset_join(d, subset).select("pid", "reply_time", "overall_sat", "q22", "q49")


@query("bind_imputed", sql=f"WITH {DERIVED_SQL} SELECT trustcode, record, q1, q10, q22, q74, outcome, "
       "mailing1, mailing2, mailing3, daterec FROM inpatient")
def bind_imputed(spark, sf_dir):
    """Answer columns and time columns of the same wave bound by key, not position."""
    r = raw(spark, sf_dir)
    answers = r.select("trustcode", "record", "q1", "q10", "q22", "q74")
    times = r.select("trustcode", "record", "outcome", "mailing1", "mailing2", "mailing3", "daterec")
    return J.bind_imputed(answers, times)


@query("exclude_trusts", sql=with_derived(
    "SELECT trustcode, record, reply_time, overall_tri FROM d WHERE trustcode NOT IN ('T3', 'T17')"))
def exclude_trusts(spark, sf_dir):
    """Rows of all trusts but two, dropped by code with an anti join."""
    d = derived(spark, sf_dir).select("trustcode", "record", "reply_time", "overall_tri")
    return FL.exclude_trusts(d, spark, ["T3", "T17"])
