"""The stand-in wave equals its specification (counts measured on sf0.01)."""

from pyspark.sql import functions as F

from replytime.sources.fixture import inpatient

from .conftest import SF001


def test_fixture_counts(spark, derived001):
    raw = inpatient(spark, SF001)
    r = raw.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("trustcode").alias("trusts"),
        F.count("daterec").alias("daterec"), F.count("q74").alias("q74"),
        F.count("mailing3").alias("mail3"),
        F.sum((F.col("outcome") == "Returned useable questionnaire").cast("int")).alias("ret"),
        F.sum(((F.col("outcome") == "Returned useable questionnaire") & F.col("daterec").isNull()).cast("int")).alias("ret_nodate"),
        F.sum(((F.col("outcome") == "Returned useable questionnaire") & F.col("q74").isNull()).cast("int")).alias("ret_norating"),
        F.sum((F.col("los") == 0).cast("int")).alias("los0"),
        F.sum((F.col("all_gender") == "Missing data").cast("int")).alias("gmiss"),
        F.count("q1").alias("q1"), F.count("q22").alias("q22"), F.count("q49").alias("q49"),
        F.count("q72").alias("q72"),
    ).first().asDict()
    assert r == dict(rows=15000, trusts=25, daterec=7975, q74=7260, mail3=14911, ret=7480,
                     ret_nodate=78, ret_norating=220, los0=745, gmiss=179, q1=13481, q22=11988,
                     q49=12537, q72=11306)
    ages = {x["age_group"]: x["count"] for x in raw.groupBy("age_group").count().collect()}
    assert ages == {"16-35": 2958, "36-50": 3085, "51-65": 2983, "66+": 5974}
    strata = {x["reply_strata"]: x["count"] for x in derived001.groupBy("reply_strata").count().collect()}
    assert strata == {"Mail1": 4342, "Mail2": 2019, "Mail3": 1023, None: 7616}


def test_raw_reply_time(spark, derived001):
    raw_days = F.datediff("new_date_rec", "mail1")
    r = derived001.where(F.col("new_date_rec").isNotNull()).agg(
        F.sum((raw_days <= 0).cast("int")).alias("nonpos"), F.min(raw_days).alias("mn"),
        F.max(raw_days).alias("mx"), F.countDistinct(raw_days).alias("nd"),
        F.median(raw_days).alias("med")).first()
    assert (r.nonpos, r.mn, r.mx, r.nd, r.med) == (148, -19, 98, 115, 71)
