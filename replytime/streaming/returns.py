"""Incremental tally of returned questionnaires with Structured Streaming.

Waves arrive as files; each micro-batch adds its usable returns to a
per-(trust, day) count kept in the streaming state, which is bounded by the
trusts and the days of the survey.  By default no watermark is set, so files
may arrive in any order and every row counts.  Output runs in update mode through ``foreachBatch``
into a Parquet table (append of (key, running count, batch id)); readers take
the latest count per key, so a restarted query (same checkpoint) resumes
without double counting.

The study itself read whole files once; this is the same tally computed as
data arrives.  For an endless stream a caller may name a watermark: days
older than it are then final, and rows that arrive later do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import spss_to_date
from ..levels import RETURNED_LABEL
from ..sources.scan import SURVEY_SCHEMA


def returns_stream(spark: SparkSession, source: str, max_files_per_trigger: int = 4) -> DataFrame:
    """Streaming DataFrame of questionnaire rows arriving as Parquet files in ``source``."""
    return (spark.readStream.schema(SURVEY_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(source))


def daily_returns(rows: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running count of usable returns per trust and received day (event-time windows)."""
    ret = rows.where((F.col("outcome") == RETURNED_LABEL) & F.col("daterec").isNotNull())
    # event time = midnight (UTC) of the received day; independent of the session time zone
    day_ts = F.timestamp_seconds(F.unix_date(spss_to_date("daterec")).cast("long") * F.lit(86400))
    ret = ret.select("trustcode", day_ts.alias("received_ts"))
    if watermark:
        ret = ret.withWatermark("received_ts", watermark)
    return (ret.groupBy("trustcode", "received_ts")
            .agg(F.count(F.lit(1)).alias("returns"))
            .select("trustcode", F.date_from_unix_date(
                F.floor(F.unix_seconds("received_ts") / F.lit(86400)).cast("int")).alias("day"), "returns"))


def run_daily_returns(spark: SparkSession, source: str, sink: str, checkpoint: str,
                      watermark: str | None = None, max_files_per_trigger: int = 4) -> None:
    """Process every file now in ``source`` (availableNow trigger) and stop."""
    agg = daily_returns(returns_stream(spark, source, max_files_per_trigger), watermark)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (agg.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_daily_returns(spark: SparkSession, sink: str) -> DataFrame:
    """Latest running count per (trust, day) from the update log."""
    log = spark.read.parquet(sink)
    return log.groupBy("trustcode", "day").agg(F.max_by("returns", "batch_id").alias("returns"))
