"""DuckDB SQL for the derived analysis table.

The derivations are written separately from the DataFrame code; the answer
levels and the stand-in wave's rows (``INPATIENT_SQL``) come from the library's
constants, so a wrong label there would not show here.

``with_derived(select_sql)`` prefixes a query with the CTE chain
``inpatient -> dd (dates) -> sc (scalars) -> d1 -> d2 -> d``.
"""

from __future__ import annotations

from ..levels import RATING_LEVELS
from ..sources.fixture import INPATIENT_SQL

_SPSS0 = 12219379200  # seconds from the SPSS origin to 1970-01-01


def _date(col: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor(({col} - {_SPSS0}) / 86400.0) AS INTEGER))"


_RATING_VALUES = ", ".join(f"('{lvl}', {i + 1})" for i, lvl in enumerate(RATING_LEVELS))

DERIVED_SQL = INPATIENT_SQL + f""",
dd AS (
  SELECT *, {_date('daterec')} AS date_rec, {_date('mailing1')} AS mail1,
         {_date('mailing2')} AS mail2, {_date('mailing3')} AS mail3
  FROM inpatient
),
sc AS (SELECT max(date_rec) AS max_date FROM dd),
rating_dict AS (SELECT * FROM (VALUES {_RATING_VALUES}) v(level, ord)),
rating_used AS (
  SELECT level, CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS code
  FROM rating_dict WHERE level IN (SELECT q74 FROM dd WHERE q74 IS NOT NULL)
),
d1 AS (
  SELECT dd.*, sc.max_date, ru.code AS overall_sat,
    CASE WHEN outcome = 'Returned useable questionnaire' THEN 'Returned'
         WHEN outcome IN ('Not returned, reason unknown', 'Returned blank, opted out') THEN 'Not returned'
         ELSE NULL END AS new_outcome
  FROM dd CROSS JOIN sc LEFT JOIN rating_used ru ON dd.q74 = ru.level
),
d2 AS (
  SELECT *,
    CASE WHEN new_outcome IS NULL THEN NULL WHEN new_outcome = 'Not returned' THEN max_date
         ELSE date_rec END AS new_date_rec,
    CASE WHEN (date_rec <= mail2 AND outcome = 'Returned useable questionnaire') IS NULL THEN NULL
         WHEN (date_rec <= mail2 AND outcome = 'Returned useable questionnaire') THEN 'Mail1'
         WHEN (date_rec <= mail3 AND date_rec > mail2 AND outcome = 'Returned useable questionnaire') IS NULL THEN NULL
         WHEN (date_rec <= mail3 AND date_rec > mail2 AND outcome = 'Returned useable questionnaire') THEN 'Mail2'
         WHEN (date_rec > mail3 AND outcome = 'Returned useable questionnaire') IS NULL THEN NULL
         WHEN (date_rec > mail3 AND outcome = 'Returned useable questionnaire') THEN 'Mail3'
         ELSE NULL END AS reply_strata
  FROM d1
),
d3 AS (
  SELECT *,
    CASE WHEN new_date_rec > mail1 THEN CAST(new_date_rec - mail1 AS INTEGER) END AS reply_time,
    CASE WHEN reply_strata = 'Mail1' AND new_date_rec > mail1 THEN CAST(new_date_rec - mail1 AS INTEGER) END AS reply_time1,
    CASE WHEN reply_strata = 'Mail2' AND new_date_rec > mail2 THEN CAST(new_date_rec - mail2 AS INTEGER) END AS reply_time2,
    CASE WHEN reply_strata = 'Mail3' AND new_date_rec > mail3 THEN CAST(new_date_rec - mail3 AS INTEGER) END AS reply_time3,
    CASE WHEN new_outcome = 'Returned' THEN 1 WHEN new_outcome = 'Not returned' THEN 0 END AS event,
    CASE WHEN los IS NULL THEN NULL WHEN los < 1 THEN 0.0 ELSE ln(CAST(los AS DOUBLE)) END AS log_los,
    CASE WHEN q10 IS NULL THEN NULL WHEN q10 = 'Yes' THEN 'Yes' ELSE 'No' END AS choice,
    CASE WHEN q1 IS NULL THEN NULL WHEN q1 = 'Emergency or urgent' THEN 'yes' ELSE 'no' END AS emergency,
    CASE WHEN overall_sat IS NULL THEN NULL WHEN overall_sat = 1 THEN 'Excellent'
         WHEN overall_sat = 2 THEN 'Very good' ELSE 'Other' END AS overall_tri,
    CASE WHEN all_gender = 'Missing data' THEN NULL ELSE all_gender END AS gender,
    CASE WHEN reply_strata = 'Mail1' THEN 'First' WHEN reply_strata IN ('Mail2', 'Mail3') THEN 'Later' END AS reply_strata2,
    CASE WHEN reply_strata = 'Mail1' THEN 'First' WHEN reply_strata IN ('Mail2', 'Mail3') THEN 'Repeated' END AS rep_mail
  FROM d2
),
d AS (
  SELECT *,
    CASE WHEN reply_time <= 14 THEN 'Early' WHEN reply_time > 14 THEN 'Late' END AS early,
    CASE WHEN reply_time IS NULL THEN NULL WHEN reply_time > 21 THEN 'Late' ELSE 'Early' END AS late,
    CASE WHEN reply_time1 IS NULL THEN NULL WHEN reply_time1 > 21 THEN 'Late' ELSE 'Early' END AS late1,
    CASE WHEN reply_time2 IS NULL THEN NULL WHEN reply_time2 > 21 THEN 'Late' ELSE 'Early' END AS late2,
    CASE WHEN reply_time3 IS NULL THEN NULL WHEN reply_time3 > 21 THEN 'Late' ELSE 'Early' END AS late3
  FROM d3
)"""


_BACK = "CAST((record % 4 - 3) * 365 AS DOUBLE) * 86400.0"

_RAW4 = f""",
inpatient4 AS (
  SELECT CAST(2006 + record % 4 AS INTEGER) AS wave, trustcode, record, outcome, mailing1 + {_BACK} AS mailing1,
         mailing2 + {_BACK} AS mailing2, mailing3 + {_BACK} AS mailing3, daterec + {_BACK} AS daterec, los, age_group,
         all_gender, q1, q6, q10, q22, q32, q36, q49, q72, q74
  FROM inpatient
)"""


def _by_wave() -> str:
    """The derivation with its two global facts (last date, rating levels in use) taken per wave."""
    text = DERIVED_SQL
    for old, new in (
        (",\ndd AS (", _RAW4 + ",\ndd AS ("),
        ("FROM inpatient\n),\nsc AS", "FROM inpatient4\n),\nsc AS"),
        ("sc AS (SELECT max(date_rec) AS max_date FROM dd)",
         "sc AS (SELECT wave, max(date_rec) AS max_date FROM dd GROUP BY wave)"),
        ("""  SELECT level, CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS code
  FROM rating_dict WHERE level IN (SELECT q74 FROM dd WHERE q74 IS NOT NULL)
""", """  SELECT wave, level, CAST(row_number() OVER (PARTITION BY wave ORDER BY ord) AS INTEGER) AS code
  FROM rating_dict JOIN (SELECT DISTINCT wave, q74 FROM dd) u ON u.q74 = level
"""),
        ("FROM dd CROSS JOIN sc LEFT JOIN rating_used ru ON dd.q74 = ru.level",
         "FROM dd JOIN sc ON sc.wave = dd.wave LEFT JOIN rating_used ru ON dd.q74 = ru.level AND ru.wave = dd.wave"),
    ):
        if text.count(old) != 1:
            raise ValueError(f"the derivation's text has changed: {old}")
        text = text.replace(old, new)
    return text


DERIVED4_SQL = _by_wave()


def with_waves(body: str, extra_ctes: str = "") -> str:
    """Like ``with_derived``, over four waves with censoring and levels of their own."""
    return f"WITH {DERIVED4_SQL + (',' + extra_ctes if extra_ctes.strip() else '')}\n{body}"


def with_derived(body: str, extra_ctes: str = "") -> str:
    """Full oracle text: derived-table CTEs, optional more CTEs, then ``body``."""
    ctes = DERIVED_SQL + ("," + extra_ctes if extra_ctes.strip() else "")
    return f"WITH {ctes}\n{body}"


def km_sql(source: str, group_cols: str = "", digits: int = 8) -> str:
    """Kaplan-Meier CTE text over ``source`` (columns: [grp...,] time, event)."""
    g = f"{group_cols}, " if group_cols else ""
    part = f"PARTITION BY {group_cols}" if group_cols else ""
    return f"""
km_t AS (
  SELECT {g}time, count(*) AS n_at, CAST(sum(event) AS BIGINT) AS n_event FROM {source} GROUP BY {g}time
),
km_r AS (
  SELECT *, CAST(sum(n_at) OVER (PARTITION BY {group_cols or '1'}) - coalesce(sum(n_at) OVER ({part} ORDER BY time
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_risk
  FROM km_t
),
km_c AS (
  SELECT *,
    max(CASE WHEN n_event >= n_risk THEN 1 ELSE 0 END) OVER ({part} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z,
    sum(CASE WHEN n_event < n_risk THEN ln(1.0 - CAST(n_event AS DOUBLE) / CAST(n_risk AS DOUBLE)) ELSE 0.0 END)
      OVER ({part} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lns,
    sum(CASE WHEN n_event < n_risk THEN CAST(n_event AS DOUBLE) / (CAST(n_risk AS DOUBLE) * CAST(n_risk - n_event AS DOUBLE)) ELSE 0.0 END)
      OVER ({part} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gw
  FROM km_r
),
km AS (
  SELECT {g}time, n_risk, n_event, n_at - n_event AS n_censor,
    CASE WHEN z = 1 THEN 0.0 ELSE exp(lns) END AS surv, gw, z, lns
  FROM km_c
)"""
