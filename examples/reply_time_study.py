"""The reply-time study end to end on one wave, writing every table as Parquet.

    python examples/reply_time_study.py [wave_path_or_testdata_dir] [out_dir]

With a test-data folder (containing orders/customer parquet) the stand-in
wave is used; otherwise the path is read as a survey wave with the fixed
schema.  Output goes to ``out_dir`` (default: a folder under the session's
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import replytime as rt  # noqa: E402
from replytime import levels as L  # noqa: E402
from replytime.session import get_spark  # noqa: E402
from replytime.sources.scan import scratch_path  # noqa: E402


def main() -> None:
    src = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    out = sys.argv[2] if len(sys.argv) > 2 else scratch_path(spark, "study")
    if os.path.exists(os.path.join(src, "orders.parquet")):
        from replytime.sources.fixture import inpatient
        wave = inpatient(spark, src)
    else:
        wave = rt.survey_scan(spark, src)

    d = rt.derive_wave(wave)
    tri = rt.Factor("overall_tri", ("Excellent", "Other", "Very good"))
    covars = [rt.Factor("emergency", ("no", "yes")), rt.Factor("age_group", L.AGE_LEVELS),
              rt.Numeric("log_los"), rt.Factor("gender", ("Female", "Male"))]

    tables = {
        "response_rate_by_trust": rt.response_rate_by_trust(d),
        "reply_strata_by_satisfaction": rt.cross_table(d, "reply_strata2", "overall_tri"),
        "km_by_satisfaction": rt.kaplan_meier(
            rt.survival_pair(d.where(d.overall_tri.isNotNull()), "reply_time", "event", by=("overall_tri",)),
            by=("overall_tri",)),
        "km_by_trust": rt.kaplan_meier(rt.survival_pair(d, "reply_time", "event", by=("trustcode",)),
                                       by=("trustcode",), conf=False),
        "hazard": rt.hazard_kernel(rt.survival_pair(d, "reply_time", "event"), 5.0),
        "los_t_test": rt.welch_t_test(d, "los", "reply_strata2", ("First", "Later")),
    }
    fits = {
        "aft_loglogistic": rt.fit_loglogistic(d, "reply_time", "event", [tri] + covars, cluster="trustcode"),
        "cox": rt.fit_cox(d, "reply_time", "event", [tri], cluster="trustcode"),
        "later_reply_glmm": rt.fit_glmm_logit(d, "reply_strata2", "Later", [tri], "trustcode"),
        "satisfaction_ordinal": rt.fit_ordinal(d, "overall_tri", L.SATISFACTION_TRI_ORDERED,
                                               [rt.Factor("reply_strata", L.STRATA_LEVELS)] + covars),
    }
    for name, fit in fits.items():
        tables[name] = fit.table(spark)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        print(f"{name}: {out}/{name}")


if __name__ == "__main__":
    main()
