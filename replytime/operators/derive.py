"""From raw questionnaire rows to the analysis table of one wave.

Everything is a projection over the scan except two global facts that the
rules need: the last received date (censoring time for non-returns) and
which rating levels occur (the rating code counts only used levels).  Both
come from ONE partial aggregate over the rows, used as a scalar subquery, so
the plan is scan -> partial agg -> one-row result inlined into a single
fused projection: no join and no shuffle of row data.  Censoring per group
(``censor_by``) instead joins a one-row-per-group aggregate back by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import levels as L
from ..functions import recode as R
from ..functions.core import los_transform, r_switch, reply_days, spss_to_date


def used_levels_expr(col: str, levels) -> Column:
    """Aggregate expression: the levels of ``levels`` that occur, in order."""
    flags = [F.when(F.max((F.col(col) == F.lit(lvl)).cast("int")) == 1, F.lit(lvl)) for lvl in levels]
    return F.array_compact(F.array(*flags))


def ordinal_code(df: DataFrame, col: str, levels, out: str) -> DataFrame:
    """Code a labelled column 1..k over the levels that occur, in dictionary order.

    Labels outside the dictionary get NULL.
    """
    used = df.agg(used_levels_expr(col, levels).alias("lv")).scalar()
    return df.withColumn(out, F.array_position(used, F.col(col)).cast("int")).withColumn(
        out, F.when(F.col(out) > 0, F.col(out)))


def drop_missing_level(col, label: str = L.MISSING_DATA_LABEL) -> Column:
    """Treat the explicit "Missing data" label as a missing value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(label))


def with_dates(df: DataFrame, mail_cols=("mailing1", "mailing2", "mailing3"),
               rec_col: str = "daterec") -> DataFrame:
    """SPSS seconds to dates: ``date_rec``, ``mail1``, ``mail2``, ``mail3``."""
    return df.withColumns({
        "date_rec": spss_to_date(rec_col),
        "mail1": spss_to_date(mail_cols[0]),
        "mail2": spss_to_date(mail_cols[1]),
        "mail3": spss_to_date(mail_cols[2]),
    })


def censor_scalars(df: DataFrame, rating_col: str = "q74", rating_levels=L.RATING_LEVELS) -> Column:
    """One scalar subquery: last received date and used rating levels."""
    stats = df.agg(F.struct(
        F.max("date_rec").alias("max_date"),
        used_levels_expr(rating_col, rating_levels).alias("rating_levels"),
    ).alias("s"))
    return stats.scalar()


def censor_facts(raw: DataFrame, rating_col: str = "q74", rating_levels=L.RATING_LEVELS) -> tuple:
    """The two global facts of a wave, read once: (last received date, used rating levels).

    Given to ``derive_wave``, every later query over the wave scans it once.
    """
    row = raw.agg(F.max(spss_to_date("daterec")).alias("d"), used_levels_expr(rating_col, rating_levels).alias("lv")).first()
    return row["d"], tuple(row["lv"] or ())


def group_scalars(df: DataFrame, keys, rating_col: str = "q74", rating_levels=L.RATING_LEVELS) -> DataFrame:
    """Per group (e.g. per wave or per trust): last received date and used rating levels.

    One row per group; joined back by key (a hot group is no problem: the
    aggregate is combined map-side before the shuffle, and AQE broadcasts the
    small side or splits a skewed partition).
    """
    return df.groupBy(*keys).agg(F.max("date_rec").alias("max_date"),
                                 used_levels_expr(rating_col, rating_levels).alias("rating_levels"))


def derive_wave(raw: DataFrame, rating_col: str = "q74", censor_by=None, floor_los: bool = True,
                censor_by_trust: bool = False, facts: tuple | None = None) -> DataFrame:
    """Analysis table of one wave (2009 rules).

    Columns added: ``date_rec, mail1..3, overall_sat, max_date, new_outcome,
    new_date_rec, reply_strata, reply_time, reply_time1..3, event, log_los,
    choice, emergency, overall_tri, gender, early, reply_strata2, rep_mail,
    late, late1..3``.

    * ``event``: 1 returned, 0 not returned (censored), NULL otherwise.
    * ``reply_time``: days from first mailing to the received date, the last
      received date for non-returns; NULL unless strictly positive.
    * ``reply_time1..3``: days since the mailing that produced the reply;
      only returned rows have one, so they carry no censored rows.
    * ``censor_by``: group keys whose own last received date censors their
      non-returns (``("wave",)`` for several waves in one table,
      ``("trustcode",)`` for the per-trust variant); the rating levels are
      then also taken per group.  Default: the whole table (scalar subquery,
      or ``facts`` from ``censor_facts``, which saves the second scan).
    """
    d = with_dates(raw)
    if censor_by_trust and not censor_by:
        censor_by = ("trustcode",)
    if censor_by:
        d = d.join(group_scalars(d, list(censor_by), rating_col), list(censor_by), "left")
    elif facts is not None:
        last, used = facts
        d = d.withColumns({"max_date": F.lit(last).cast("date"),
                           "rating_levels": F.array(*[F.lit(v) for v in used]).cast("array<string>")})
    else:
        s = censor_scalars(d, rating_col)
        d = d.withColumns({"max_date": s.getField("max_date"),
                           "rating_levels": s.getField("rating_levels")})
    # position among the used levels; 0 (not a level) -> NULL, one reference to the input
    code = F.nullif(F.array_position(F.col("rating_levels"), F.col(rating_col)).cast("int"), F.lit(0))
    d = d.withColumn("overall_sat", code).drop("rating_levels")

    o = F.col("outcome")
    d = d.withColumns({
        "new_outcome": R.outcome_class("outcome"),
        # ifelse(new_outcome == "Not returned", max_date, date_rec), stated on the
        # outcome label directly (NULL class -> NULL) to keep the expression flat
        "new_date_rec": F.when(o.isin(*L.NOT_RETURNED_LABELS), F.col("max_date"))
                         .when(o.isin(L.RETURNED_LABEL), F.col("date_rec")),
        "reply_strata": R.reply_strata("date_rec", "mail2", "mail3", "outcome"),
    })

    ndr = F.col("new_date_rec")

    def since(m):
        return F.when(ndr > F.col(m), reply_days(ndr, F.col(m)))

    strata = F.col("reply_strata")
    d = d.withColumns({
        "reply_time": since("mail1"),
        "reply_time1": F.when(strata == "Mail1", since("mail1")),
        "reply_time2": F.when(strata == "Mail2", since("mail2")),
        "reply_time3": F.when(strata == "Mail3", since("mail3")),
        "event": R.event_flag("new_outcome"),
        "log_los": los_transform("los", floor_at_one=floor_los),
        "choice": R.choice_q10("q10"),
        "emergency": R.emergency("q1"),
        "overall_tri": R.satisfaction_tri("overall_sat"),
        "gender": drop_missing_level("all_gender"),
        "reply_strata2": R.strata_first_later("reply_strata"),
        "rep_mail": R.repeat_mail_flag("reply_strata"),
    })
    return d.withColumns({
        "early": R.early_flag("reply_time", 14),
        "late": R.late_flag("reply_time", 21),
        "late1": R.late_flag("reply_time1", 21),
        "late2": R.late_flag("reply_time2", 21),
        "late3": R.late_flag("reply_time3", 21),
    })


def reply_time_coalesced(strata: str | None = None) -> Column:
    """Days since the mailing that triggered the reply (NULL without a stratum).

    In the derived table ``reply_timeK`` is non-NULL only when the stratum is
    MailK, so the switch on the stratum equals a coalesce of the three - the
    short form keeps downstream generated code small.  Pass ``strata`` to
    switch explicitly on a stratum column instead.
    """
    if strata is None:
        return F.coalesce(F.col("reply_time1"), F.col("reply_time2"), F.col("reply_time3"))
    return r_switch(strata, {"Mail1": F.col("reply_time1"), "Mail2": F.col("reply_time2"),
                             "Mail3": F.col("reply_time3")}, F.lit(None).cast("int"))


def with_ordered_outcomes(d: DataFrame) -> DataFrame:
    """Ordered answer scales used by the ordinal models (labels; order in ``levels``)."""
    return d.withColumns({
        "clean_tri": R.clean_tri("q22"),
        "doc_conf": F.when(F.col("q32").isin(*L.CONFIDENCE_LEVELS), F.col("q32")),
        "nurse_conf": F.when(F.col("q36").isin(*L.CONFIDENCE_LEVELS), F.col("q36")),
        "call_but": F.when(F.col("q49").isin(*L.CALL_BUTTON_LEVELS), F.col("q49")),
    })
