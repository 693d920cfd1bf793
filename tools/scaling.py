"""Scaling check: key operators on the sf0.1 wave replicated 1x / 4x / 16x.

Copies get new record ids (trust codes unchanged, so per-trust groups grow
with the data).  Each replicated wave is written once under the checkpoint
folder; then every operator runs on it end to end.  Prints one line per
(factor, operator) with seconds.  Usage: python tools/scaling.py [factors...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    import replytime as rt
    from replytime import levels as L
    from replytime.session import get_spark
    from replytime.sources.fixture import inpatient
    from replytime.sources.scan import SURVEY_SCHEMA, scratch_path

    spark = get_spark()
    factors = [int(a) for a in sys.argv[1:]] or [1, 4, 16]
    base = inpatient(spark, "/root/testdata/sf0.1")
    n = base.count()
    tri = rt.Factor("overall_tri", ("Excellent", "Other", "Very good"))
    covars = [rt.Factor("emergency", ("no", "yes")), rt.Factor("age_group", L.AGE_LEVELS),
              rt.Numeric("log_los"), rt.Factor("gender", ("Female", "Male"))]
    ops = {
        "km_by_group": lambda d: rt.kaplan_meier(rt.survival_pair(d, "reply_time", "event", by=("overall_tri",)),
                                                 by=("overall_tri",)).write.format("noop").mode("overwrite").save(),
        "cross_table": lambda d: rt.cross_table(d, "reply_strata2", "overall_tri").write.format("noop")
        .mode("overwrite").save(),
        "ols_full": lambda d: rt.fit_lm(d, "reply_time", [tri] + covars),
        "aft_cluster": lambda d: rt.fit_loglogistic(d, "reply_time", "event", [tri] + covars, cluster="trustcode"),
        "cox_cluster": lambda d: rt.fit_cox(d, "reply_time", "event", [tri], cluster="trustcode"),
        "reml": lambda d: rt.fit_lmm(d, "reply_time", [tri], "trustcode"),
    }
    for f in factors:
        copies = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(f - 1))).alias("_c"))
        rep = copies.withColumn("record", F.col("record") + F.col("_c") * F.lit(n)).drop("_c")
        path = scratch_path(spark, f"scaling-x{f}")
        rep.write.mode("overwrite").parquet(path)
        wave = spark.read.schema(SURVEY_SCHEMA).parquet(path)
        for name, op in ops.items():
            t = time.perf_counter()
            op(rt.derive_wave(wave))
            print(f"x{f:<3d} rows={n * f:>9d} {name:12s} {time.perf_counter() - t:6.2f}s", flush=True)


if __name__ == "__main__":
    main()
