"""Recodes of survey answers, each a null-faithful Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import levels as L
from .core import _c, r_case, r_ifelse


def outcome_class(outcome, returned=(L.RETURNED_LABEL,),
                  not_returned=L.NOT_RETURNED_LABELS) -> Column:
    """'Returned' / 'Not returned' / NULL for every other outcome."""
    o = _c(outcome)
    return (F.when(o.isin(*returned), F.lit("Returned"))
            .when(o.isin(*not_returned), F.lit("Not returned")))


def _lookup(mapping: dict, col) -> Column:
    """Map lookup referencing ``col`` once (NULL or unmapped value -> NULL).

    Derived columns are inlined into downstream filters and aggregates, so
    a recode that names its input once keeps the generated code small.
    """
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(col))


def event_flag(new_outcome) -> Column:
    """1 = returned (event), 0 = not returned (censored), NULL otherwise."""
    return _lookup({"Returned": 1, "Not returned": 0}, new_outcome)


def event_flag_wave(outcome) -> Column:
    """Four-wave variant: 1 for a usable return, 0 for every other outcome."""
    return r_ifelse(_c(outcome) == L.RETURNED_LABEL, F.lit(1), F.lit(0))


def reply_strata(date_rec, mail2, mail3, outcome=None) -> Column:
    """Mailing that produced the reply: 'Mail1' / 'Mail2' / 'Mail3' / NULL.

    With ``outcome`` given, only usable returns get a stratum (2009 rule);
    without it only the dates are used (2006 rule).
    """
    d, m2, m3 = _c(date_rec), _c(mail2), _c(mail3)
    ok = (_c(outcome) == L.RETURNED_LABEL) if outcome is not None else None

    def w(c):
        return c & ok if ok is not None else c

    return r_case(
        (w(d <= m2), F.lit("Mail1")),
        (w((d <= m3) & (d > m2)), F.lit("Mail2")),
        (w(d > m3), F.lit("Mail3")),
        default=F.lit(None).cast("string"),
    )


def repeat_mail_flag(strata) -> Column:
    """'First' for Mail1, 'Repeated' for Mail2 / Mail3."""
    return _lookup({"Mail1": "First", "Mail2": "Repeated", "Mail3": "Repeated"}, strata)


def strata_first_later(strata) -> Column:
    """'First' for Mail1, 'Later' for Mail2 / Mail3."""
    return _lookup({"Mail1": "First", "Mail2": "Later", "Mail3": "Later"}, strata)


def early_flag(time, days: int = 14) -> Column:
    """'Early' when time <= days, 'Late' when above, NULL when time is NULL."""
    t = _c(time)
    # NULL time -> NULL; otherwise one comparison decides (same as the nested ifelse)
    return F.when(t.isNotNull(), F.when(t <= days, F.lit("Early")).otherwise(F.lit("Late")))


def late_flag(time, days: int = 21) -> Column:
    """'Late' when time > days else 'Early'; NULL time gives NULL."""
    t = _c(time)
    return F.when(t > days, F.lit("Late")).when(t.isNotNull(), F.lit("Early"))


def satisfaction_tri(code) -> Column:
    """Rating code 1 -> Excellent, 2 -> Very good, other non-null -> Other."""
    c = _c(code)
    exc, vg, oth = L.SATISFACTION_TRI_LABELS
    return F.when(c.isNotNull(), F.coalesce(_lookup({1: exc, 2: vg}, c), F.lit(oth)))


def satisfaction_binary(code) -> Column:
    """Rating code below 4 -> 'Good', else 'Poor.Fair'."""
    return r_ifelse(_c(code) < 4, F.lit("Good"), F.lit("Poor.Fair"))


def satisfaction_score(code) -> Column:
    """Rating code 1..5 -> 100, 75, 50, 25, 0 (any other non-null code -> 0)."""
    c = _c(code)
    s = L.SATISFACTION_SCORES
    return F.when(c.isNotNull(), F.coalesce(_lookup({1: s[0], 2: s[1], 3: s[2], 4: s[3]}, c), F.lit(s[4])))


def emergency(q1) -> Column:
    """'yes' for an emergency admission, else 'no' (NULL stays NULL)."""
    return r_ifelse(_c(q1) == L.EMERGENCY_LABEL, F.lit("yes"), F.lit("no"))


def choice_q10(q10) -> Column:
    """Choice of admission date: 'Yes' / 'No'."""
    return r_ifelse(_c(q10) == L.CHOICE_Q10_YES, F.lit("Yes"), F.lit("No"))


def choice_q6(q6) -> Column:
    """Choice of hospital: 'No' if a choice was wanted but not given, else 'Other'."""
    return r_ifelse(_c(q6) == L.CHOICE_Q6_NO, F.lit("No"), F.lit("Other"))


def dignity(q) -> Column:
    """'Always' treated with dignity, else 'Sometimes or no'."""
    return r_ifelse(_c(q) == L.DIGNITY_ALWAYS, F.lit("Always"), F.lit("Sometimes or no"))


def clean_tri(q22) -> Column:
    """Cleanliness collapsed to three ordered levels: Very clean / Fairly clean / Other."""
    q = _c(q22)
    oth, fair, very = L.CLEAN_TRI_ORDERED
    known = q.isin(*L.CLEAN_LEVELS)
    # a label outside the scale is not a level of the ordered factor -> NULL
    qq = F.when(known, q)
    return r_case((qq == "Very clean", F.lit(very)), (qq == "Fairly clean", F.lit(fair)),
                  (qq.isNull(), F.lit(None).cast("string")), default=F.lit(oth))


def ordered_rank(col, ordered_levels) -> Column:
    """Rank (1 = lowest) of a value in an ordered scale; NULL if not a level."""
    pos = F.array_position(F.array(*[F.lit(x) for x in ordered_levels]), _c(col))
    return F.when(pos > 0, pos.cast("int"))


def relabel(col, mapping: dict) -> Column:
    """Rename levels (``levels(x) <- ...``); unmapped values pass through."""
    c = _c(col)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)
