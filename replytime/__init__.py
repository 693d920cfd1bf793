"""Survey reply-time analytics on Spark DataFrames.

Sub-packages:

* ``sources``   - survey scans, CSV round trip, wave union, the derived test fixture
* ``functions`` - Column expressions (null-faithful conditionals, SPSS dates, recodes)
* ``operators`` - derived table, filters, joins, aggregates, survival, tests, plot tables
* ``models``    - regression fits whose passes over rows are Spark aggregations
* ``plans``     - the named queries and their DuckDB oracle SQL
* ``streaming`` - incremental tally of returns with Structured Streaming

The most used entry points are re-exported here, e.g.::

    import replytime as rt
    wave = rt.survey_scan(spark, "/data/waves/2009")
    d = rt.derive_wave(wave)
    km = rt.kaplan_meier(rt.survival_pair(d, "reply_time", "event", by=("overall_tri",)), by=("overall_tri",))
    fit = rt.fit_loglogistic(d, "reply_time", "event", [rt.Factor("overall_tri")], cluster="trustcode")
"""

__version__ = "0.1.0"

from .functions.core import inv_logit, r_case, r_ifelse, r_switch, reply_days, spss_to_date  # noqa: E402
from .levels import factor_levels  # noqa: E402
from .models.aft import fit_loglogistic, fit_weibull, loglogistic_hazard  # noqa: E402
from .models.cox import baseline_hazard, fit_cox, schoenfeld_test  # noqa: E402
from .models.design import Factor, Numeric, build_design  # noqa: E402
from .models.glm import fit_logit  # noqa: E402
from .models.glmm import fit_glmm_logit  # noqa: E402
from .models.lm import fit_lm  # noqa: E402
from .models.lmm import fit_lmm  # noqa: E402
from .models.ordinal import fit_ordinal  # noqa: E402
from .operators.derive import derive_wave, ordinal_code, reply_time_coalesced  # noqa: E402
from .operators.describe import (column_summary, cross_table, freq_table, level_codes,  # noqa: E402
                                 missing_by_column, missing_by_trust)
from .operators.joins import attach_response_rate, response_rate_by_trust  # noqa: E402
from .operators.plotdata import boxplot_stats, histogram_density, kde_density  # noqa: E402
from .operators.stattests import chi_square_independence, one_way_anova, welch_t_test  # noqa: E402
from .operators.survival import (hazard_kernel, hazard_piecewise, kaplan_meier, stack_curves,  # noqa: E402
                                 survival_pair)
from .sources.scan import csv_roundtrip, csv_scan, survey_scan, wave_union  # noqa: E402

__all__ = [
    "inv_logit", "r_case", "r_ifelse", "r_switch", "reply_days", "spss_to_date", "factor_levels",
    "fit_loglogistic", "fit_weibull", "loglogistic_hazard", "baseline_hazard", "fit_cox", "schoenfeld_test",
    "Factor", "Numeric", "build_design", "fit_logit", "fit_glmm_logit", "fit_lm", "fit_lmm", "fit_ordinal",
    "derive_wave", "ordinal_code", "reply_time_coalesced", "column_summary", "cross_table", "freq_table",
    "level_codes", "missing_by_column", "missing_by_trust", "attach_response_rate", "response_rate_by_trust",
    "boxplot_stats", "histogram_density", "kde_density", "chi_square_independence", "one_way_anova",
    "welch_t_test", "hazard_kernel", "hazard_piecewise", "kaplan_meier", "stack_curves", "survival_pair",
    "csv_roundtrip", "csv_scan", "survey_scan", "wave_union",
]
