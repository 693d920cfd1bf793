"""Stand-in survey wave built from the driver's TPC-H-like tables.

One row per order (``orders JOIN customer``) in the raw 2009 questionnaire
schema: SPSS-second dates, outcome labels, answers.  The builder only fills
that schema; none of the library's derivations happen here.  The same rules
are written once as DataFrame expressions (Spark side) and once as SQL text
(DuckDB oracle side).

Hash helpers are computed in modular form, so the products never leave the
64-bit range whatever the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..levels import CALL_BUTTON_LEVELS, CHOICE_Q6_LEVELS, CLEAN_LEVELS, CONFIDENCE_LEVELS, RATING_LEVELS

SPSS_DAY0 = 141428  # days from the SPSS origin to 1970-01-01


def _hash(k: Column, a: int, b: int, mult: int, mod: int) -> Column:
    """((k+a)*(k+b)*mult) % mod % 1000, overflow-free."""
    x = ((k + a) % mod) * ((k + b) % mod) % mod
    return (x * mult) % mod % 1000


def _pick(idx: Column, labels) -> Column:
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        expr = F.when(idx == i, F.lit(labels[i])).otherwise(expr)
    return expr


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test-data table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inpatient_from_tables(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Raw questionnaire rows (2009 column names) from orders and customers."""
    o = orders.select(
        F.col("o_orderkey").cast("long").alias("k"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderpriority").alias("pri"),
        F.col("o_totalprice").alias("tp"),
    )
    c = customer.select(
        F.col("c_custkey").alias("cust"),
        F.col("c_nationkey").cast("long").alias("n"),
        F.col("c_mktsegment").alias("seg"),
    )
    j = o.join(c, "cust")
    k, n = F.col("k"), F.col("n")
    h1 = _hash(k, 1, 7, 48271, 1000003)
    h2 = _hash(k, 3, 11, 69621, 999983)
    h3 = _hash(k, 5, 13, 16807, 999979)
    j = j.select("k", "n", "pri", "tp", "seg", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"))
    h1, h2, h3 = F.col("h1"), F.col("h2"), F.col("h3")
    pri = F.col("pri")
    m1 = F.lit(14500) + (n * 3) % 20
    lag = (F.when(h2 < 20, -h2)
           .when(h2 < 620, F.lit(3) + h3 % 18 + F.when(pri < F.lit("3"), 0).otherwise(3))
           .when(h2 < 860, F.lit(22) + h3 % 20)
           .otherwise(F.lit(43) + h3 % 38))

    def secs(days: Column) -> Column:
        return (days + F.lit(SPSS_DAY0)).cast("double") * F.lit(86400.0)

    has_date = (h1 < 495) | ((h1 >= 500) & (h1 < 540))
    outcome = (F.when(h1 < 500, F.lit("Returned useable questionnaire"))
               .when(h1 < 565, F.lit("Returned blank, opted out"))
               .when(h1 < 960, F.lit("Not returned, reason unknown"))
               .when(h1 < 980, F.lit("Deceased"))
               .otherwise(F.lit("Undelivered")))
    prio_idx = F.substring(pri, 1, 1).cast("int") - 1
    seg = F.col("seg")
    return j.select(
        F.lit(2009).alias("wave"),
        F.concat(F.lit("T"), n.cast("string")).alias("trustcode"),
        k.alias("record"),
        outcome.alias("outcome"),
        secs(m1).alias("mailing1"),
        secs(m1 + 21).alias("mailing2"),
        F.when(h3 >= 5, secs(m1 + 42)).alias("mailing3"),
        F.when(has_date, secs(m1 + lag) + F.lit(3600.0) * (h2 % 24).cast("double")).alias("daterec"),
        F.floor(F.col("tp") / F.lit(25000.0)).cast("int").alias("los"),
        F.when(seg == "BUILDING", "16-35").when(seg == "MACHINERY", "36-50")
         .when(seg == "FURNITURE", "51-65").otherwise("66+").alias("age_group"),
        F.when(h2 % 97 == 0, "Missing data").when(h1 % 2 == 0, "Male").otherwise("Female")
         .alias("all_gender"),
        F.when(h2 % 10 < 6, "Emergency or urgent").when(h2 % 10 < 9, "Waiting list or planned")
         .alias("q1"),
        _pick((h1 + 2 * h2) % 4, CHOICE_Q6_LEVELS).alias("q6"),
        F.when(h3 % 4 == 0, "Yes").when(h3 % 4 == 3, F.lit(None)).otherwise("No").alias("q10"),
        _pick(h3 % 5, CLEAN_LEVELS).alias("q22"),
        _pick(h2 % 4, CONFIDENCE_LEVELS).alias("q32"),
        _pick((h2 + h3) % 4, CONFIDENCE_LEVELS).alias("q36"),
        _pick((h1 + h3) % 6, CALL_BUTTON_LEVELS).alias("q49"),
        _pick((h1 + h2) % 4, CONFIDENCE_LEVELS).alias("q72"),
        F.when(h1 < 484, _pick(prio_idx, RATING_LEVELS)).alias("q74"),
    )


_WRITTEN: dict[tuple[str, str], str] = {}
_FRAMES: dict[tuple[str, str], DataFrame] = {}


def inpatient(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The stand-in 2009 wave for a test-data folder.

    A survey wave is a stored table; so the stand-in is written once per
    session as Parquet under the shared checkpoint folder and every query
    scans that file, as it would scan the real wave.  (Left as a lazy join,
    filters on derived columns would be pushed into the join condition and
    drag the whole generator along.)
    """
    if not materialize:
        return inpatient_from_tables(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
    from .scan import SURVEY_SCHEMA
    key = (spark.sparkContext.applicationId, sf_dir)
    df = _FRAMES.get(key)
    if df is None:
        # one DataFrame per session and folder: the file listing is done once
        df = spark.read.schema(SURVEY_SCHEMA).parquet(inpatient_path(spark, sf_dir))
        _FRAMES[key] = df
    return df


def inpatient_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the written stand-in wave (written on first use in this session)."""
    from .scan import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _WRITTEN.get(key)
    if path is None:
        built = inpatient_from_tables(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))
        path = scratch_path(spark, "inpatient")
        built.write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return path


def _sql_pick(idx: str, labels) -> str:
    arms = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(labels))
    return f"CASE {idx} {arms} ELSE NULL END"


def _sql_hash(a: int, b: int, mult: int, mod: int) -> str:
    return f"(((((k+{a}) % {mod}) * ((k+{b}) % {mod}) % {mod}) * {mult}) % {mod} % 1000)"


# The same stand-in as SQL (DuckDB dialect), used by the oracle texts.
INPATIENT_SQL = f"""
ip_base AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS k, CAST(c.c_nationkey AS BIGINT) AS n,
         o.o_orderpriority AS pri, o.o_totalprice AS tp, c.c_mktsegment AS seg
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
ip_h AS (
  SELECT *, {_sql_hash(1, 7, 48271, 1000003)} AS h1, {_sql_hash(3, 11, 69621, 999983)} AS h2,
         {_sql_hash(5, 13, 16807, 999979)} AS h3, 14500 + (n*3) % 20 AS m1
  FROM ip_base
),
ip_l AS (
  SELECT *, CASE WHEN h2 < 20 THEN 0 - h2
                 WHEN h2 < 620 THEN 3 + h3 % 18 + (CASE WHEN pri < '3' THEN 0 ELSE 3 END)
                 WHEN h2 < 860 THEN 22 + h3 % 20
                 ELSE 43 + h3 % 38 END AS lag
  FROM ip_h
),
inpatient AS (
  SELECT 2009 AS wave,
    'T' || CAST(n AS VARCHAR) AS trustcode,
    k AS record,
    CASE WHEN h1 < 500 THEN 'Returned useable questionnaire'
         WHEN h1 < 565 THEN 'Returned blank, opted out'
         WHEN h1 < 960 THEN 'Not returned, reason unknown'
         WHEN h1 < 980 THEN 'Deceased' ELSE 'Undelivered' END AS outcome,
    CAST(m1 + {SPSS_DAY0} AS DOUBLE) * 86400 AS mailing1,
    CAST(m1 + 21 + {SPSS_DAY0} AS DOUBLE) * 86400 AS mailing2,
    CASE WHEN h3 < 5 THEN NULL ELSE CAST(m1 + 42 + {SPSS_DAY0} AS DOUBLE) * 86400 END AS mailing3,
    CASE WHEN h1 < 495 OR (h1 >= 500 AND h1 < 540)
         THEN CAST(m1 + lag + {SPSS_DAY0} AS DOUBLE) * 86400 + 3600 * CAST(h2 % 24 AS DOUBLE)
         ELSE NULL END AS daterec,
    CAST(floor(tp / 25000) AS INTEGER) AS los,
    CASE seg WHEN 'BUILDING' THEN '16-35' WHEN 'MACHINERY' THEN '36-50'
             WHEN 'FURNITURE' THEN '51-65' ELSE '66+' END AS age_group,
    CASE WHEN h2 % 97 = 0 THEN 'Missing data' WHEN h1 % 2 = 0 THEN 'Male' ELSE 'Female' END AS all_gender,
    CASE WHEN h2 % 10 < 6 THEN 'Emergency or urgent' WHEN h2 % 10 < 9 THEN 'Waiting list or planned'
         ELSE NULL END AS q1,
    {_sql_pick('(h1 + 2 * h2) % 4', CHOICE_Q6_LEVELS)} AS q6,
    CASE WHEN h3 % 4 = 0 THEN 'Yes' WHEN h3 % 4 = 3 THEN NULL ELSE 'No' END AS q10,
    {_sql_pick('h3 % 5', CLEAN_LEVELS)} AS q22,
    {_sql_pick('h2 % 4', CONFIDENCE_LEVELS)} AS q32,
    {_sql_pick('(h2 + h3) % 4', CONFIDENCE_LEVELS)} AS q36,
    {_sql_pick('(h1 + h3) % 6', CALL_BUTTON_LEVELS)} AS q49,
    {_sql_pick('(h1 + h2) % 4', CONFIDENCE_LEVELS)} AS q72,
    CASE WHEN h1 < 484 THEN {_sql_pick("CAST(substr(pri, 1, 1) AS INTEGER) - 1", RATING_LEVELS)}
         ELSE NULL END AS q74
  FROM ip_l
)"""
