"""Reading and writing survey waves with fixed schemas (no inference)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Canonical (2009) source schema of one wave.
SURVEY_SCHEMA = T.StructType([
    T.StructField("wave", _I, False),
    T.StructField("trustcode", _S, False),
    T.StructField("record", _L, False),
    T.StructField("outcome", _S, False),
    T.StructField("mailing1", _D, True),
    T.StructField("mailing2", _D, True),
    T.StructField("mailing3", _D, True),
    T.StructField("daterec", _D, True),
    T.StructField("los", _I, True),
    T.StructField("age_group", _S, True),
    T.StructField("all_gender", _S, True),
    T.StructField("q1", _S, True),
    T.StructField("q6", _S, True),
    T.StructField("q10", _S, True),
    T.StructField("q22", _S, True),
    T.StructField("q32", _S, True),
    T.StructField("q36", _S, True),
    T.StructField("q49", _S, True),
    T.StructField("q72", _S, True),
    T.StructField("q74", _S, True),
])

# Column names of the earlier waves that differ from the 2009 names.
WAVE_RENAMES = {
    2006: {"mailing1": "mailing_one", "mailing2": "mailing_two", "mailing3": "mailing_three",
           "q74": "q66", "q72": "q64", "all_gender": "gender"},
    2007: {"mailing1": "mailing_one", "mailing2": "mailing_two", "mailing3": "mailing_three",
           "q74": "q68", "all_gender": "gender"},
    2008: {"mailing1": "mailing_one", "mailing2": "mailing_two", "mailing3": "mailing_three",
           "q74": "q71", "all_gender": "gender"},
    2009: {},
}


def conform(df: DataFrame, schema: T.StructType = SURVEY_SCHEMA) -> DataFrame:
    """Cast and order columns to ``schema``; absent nullable columns become NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"required column {f.name} missing")
    return df.select(*cols)


def survey_scan(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType = SURVEY_SCHEMA) -> DataFrame:
    """Load one wave with a fixed schema (column pruning and filters reach the scan)."""
    if fmt == "csv":
        return csv_scan(spark, path, schema)
    return conform(spark.read.schema(schema).format(fmt).load(path), schema)


def csv_scan(spark: SparkSession, path: str, schema: T.StructType,
             null_value: str = "NA") -> DataFrame:
    """Read CSV with a header, an explicit schema and ``NA`` as missing."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_value)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "FAILFAST").csv(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def csv_write(df: DataFrame, path: str, null_value: str = "NA") -> str:
    """Write CSV with a header and ``NA`` for missing values (labels kept verbatim)."""
    (df.write.mode("overwrite").option("header", True).option("nullValue", null_value)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def csv_roundtrip(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a derived table as CSV and read it back with the same schema.

    Types and level labels survive because the schema is carried, not inferred.
    """
    path = path or scratch_path(spark, "csv-roundtrip")
    csv_write(df, path)
    return csv_scan(spark, path, df.schema)


def parquet_roundtrip(spark: SparkSession, df: DataFrame, path: str | None = None,
                      partition_by=()) -> DataFrame:
    """Persist to Parquet (optionally partitioned, e.g. by wave) and reload."""
    path = path or scratch_path(spark, "parquet")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def as_wave(df: DataFrame, wave: int) -> DataFrame:
    """Present a canonical wave under one year's column names."""
    ren = WAVE_RENAMES[wave]
    return df.select(*[F.col(c).alias(ren.get(c, c)) for c in df.columns if c != "wave"]).withColumn(
        "wave", F.lit(wave))


def wave_union(waves: dict[int, DataFrame]) -> DataFrame:
    """Waves with their own column names -> one canonical DataFrame.

    Each wave is renamed by the config table, then the waves are combined with
    ``unionByName(allowMissingColumns=True)``: no shuffle, partitions concatenate.
    """
    out = None
    for wave, df in waves.items():
        inverse = {v: k for k, v in WAVE_RENAMES[wave].items()}
        canon = df.select(*[F.col(c).alias(inverse.get(c, c)) for c in df.columns]).withColumn(
            "wave", F.lit(wave))
        canon = conform(canon)
        out = canon if out is None else out.unionByName(canon, allowMissingColumns=True)
    return out


def select_columns(df: DataFrame, question_numbers, extra=()) -> DataFrame:
    """Project by a built name list (``q<i>`` for each number, plus extras); a name the table lacks is refused."""
    wanted = [f"q{i}" for i in question_numbers] + list(extra)
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"the table has no column {', '.join(unknown)}")
    return df.select(*wanted)
