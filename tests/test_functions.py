"""Tiny hand tables: the missing-value rules of every conditional recode."""

import datetime as dt

from pyspark.sql import functions as F

from replytime.functions import core as C
from replytime.functions import recode as R
from replytime.operators.derive import derive_wave, ordinal_code
from replytime.sources.scan import SURVEY_SCHEMA

SPSS = 12219379200.0


def _secs(d: dt.date, extra: float = 0.0) -> float:
    return (d - dt.date(1970, 1, 1)).days * 86400.0 + SPSS + extra


def test_r_ifelse_null_logic(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "cond boolean")
    out = df.select("cond", C.r_ifelse(F.col("cond"), F.lit("a"), F.lit("b")).alias("v")).collect()
    got = {r.cond: r.v for r in out}
    assert got == {True: "a", False: "b", None: None}
    # a plain CASE would have given 'b' for the NULL condition
    naive = df.select(F.when(F.col("cond"), "a").otherwise("b").alias("v")).where(F.col("cond").isNull()).first()
    assert naive.v == "b"


def test_r_case_stops_at_first_null(spark):
    df = spark.createDataFrame([(None, True), (False, True), (False, False), (True, None)], "c1 boolean, c2 boolean")
    expr = C.r_case((F.col("c1"), F.lit("one")), (F.col("c2"), F.lit("two")), default=F.lit("none"))
    got = [r.v for r in df.select(expr.alias("v")).collect()]
    assert got == [None, "two", "none", "one"]


def test_spss_dates_and_strata(spark):
    m1, m2, m3 = dt.date(2009, 6, 1), dt.date(2009, 6, 22), dt.date(2009, 7, 13)
    ret = "Returned useable questionnaire"
    rows = [
        # received on the second-mailing day -> Mail1 (<=), late evening keeps the day
        (1, ret, _secs(m1), _secs(m2), _secs(m3), _secs(m2, 86399.0)),
        # one day after the second mailing -> Mail2
        (2, ret, _secs(m1), _secs(m2), _secs(m3), _secs(m2 + dt.timedelta(days=1))),
        # after the third mailing -> Mail3
        (3, ret, _secs(m1), _secs(m2), _secs(m3), _secs(m3 + dt.timedelta(days=2))),
        # no third mailing: the Mail2 test is NULL -> stratum NULL (stops)
        (4, ret, _secs(m1), _secs(m2), None, _secs(m2 + dt.timedelta(days=1))),
        # no second mailing, not returned: FALSE branch continues, stays NULL
        (5, "Not returned, reason unknown", _secs(m1), None, _secs(m3), None),
        # received on the first-mailing day: reply time 0 -> NULL
        (6, ret, _secs(m1), _secs(m2), _secs(m3), _secs(m1)),
    ]
    schema = "record long, outcome string, mailing1 double, mailing2 double, mailing3 double, daterec double"
    raw = spark.createDataFrame(rows, schema)
    for f in SURVEY_SCHEMA.fields:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast(f.dataType))
    d = derive_wave(raw.withColumn("trustcode", F.lit("T1")))
    got = {r.record: (r.reply_strata, r.reply_time, r.reply_time1, r.reply_time2, r.reply_time3, r.event)
           for r in d.collect()}
    last = m3 + dt.timedelta(days=2)
    assert got[1] == ("Mail1", 21, 21, None, None, 1)
    assert got[2] == ("Mail2", 22, None, 1, None, 1)
    assert got[3] == ("Mail3", 44, None, None, 2, 1)
    assert got[4] == (None, 22, None, None, None, 1)
    # censored at the last received date of the wave
    assert got[5] == (None, (last - m1).days, None, None, None, 0)
    assert got[6] == ("Mail1", None, None, None, None, 1)


def test_thresholds(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (14,), (15,), (21,), (22,), (None,)], "t int")
    out = df.select("t", R.early_flag("t").alias("e"), R.late_flag("t").alias("l"),
                    C.nonpositive_to_null("t").alias("pos"), C.nonpositive_to_null("t", 0, False).alias("nn"))
    got = {r.t: (r.e, r.l, r.pos, r.nn) for r in out.collect()}
    assert got[14] == ("Early", "Early", 14, 14)
    assert got[15] == ("Late", "Early", 15, 15)
    assert got[21] == ("Late", "Early", 21, 21)
    assert got[22] == ("Late", "Late", 22, 22)
    assert got[0] == ("Early", "Early", None, 0)
    assert got[-1] == ("Early", "Early", None, None)
    assert got[None] == (None, None, None, None)


def test_ordinal_code_skips_unused_levels(spark):
    df = spark.createDataFrame([("Excellent",), ("Good",), ("Poor",), (None,), ("Bogus",)], "q74 string")
    levels = ("Excellent", "Very good", "Good", "Fair", "Poor")
    got = {r.q74: r.code for r in ordinal_code(df, "q74", levels, "code").collect()}
    assert got == {"Excellent": 1, "Good": 2, "Poor": 3, None: None, "Bogus": None}


def test_los_transform(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (3,)], "los int")
    out = df.select("los", C.los_transform("los").alias("f"), C.los_transform("los", False).alias("r"))
    got = {r.los: (r.f, r.r) for r in out.collect()}
    assert got[0] == (0.0, None)
    assert got[1] == (0.0, 0.0)
    assert got[None] == (None, None)
    assert abs(got[3][0] - 1.0986122886681098) < 1e-12


def test_choice_rules(spark):
    df = spark.createDataFrame([("Yes", "No, but I would have liked a choice", "Yes, always"),
                                ("No", "Yes", "No"), (None, None, None)], "q10 string, q6 string, q64 string")
    out = df.select(R.choice_q10("q10").alias("a"), R.choice_q6("q6").alias("b"), R.dignity("q64").alias("c"))
    assert [tuple(r) for r in out.collect()] == [("Yes", "No", "Always"), ("No", "Other", "Sometimes or no"),
                                                  (None, None, None)]


def test_satisfaction_recodes(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "s int")
    out = df.select("s", R.satisfaction_tri("s").alias("t"), R.satisfaction_binary("s").alias("b"),
                    R.satisfaction_score("s").alias("c"))
    got = {r.s: (r.t, r.b, r.c) for r in out.collect()}
    assert got == {1: ("Excellent", "Good", 100), 2: ("Very good", "Good", 75), 3: ("Other", "Good", 50),
                   4: ("Other", "Poor.Fair", 25), 5: ("Other", "Poor.Fair", 0), None: (None, None, None)}


def test_inv_logit_stable(spark):
    df = spark.createDataFrame([(0.0,), (800.0,), (-800.0,), (None,)], "x double")
    got = [r.p for r in df.select(C.inv_logit("x").alias("p")).collect()]
    assert got[0] == 0.5 and got[1] == 1.0 and got[2] == 0.0 and got[3] is None
