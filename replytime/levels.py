"""Level dictionary: labelled categoricals are data, not string order.

A factor's integer code is its rank among the levels that occur, in the
dictionary's order (never alphabetical unless the dictionary says so).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Labels and level orders that must equal the source study's.
# ---------------------------------------------------------------------------
RETURNED_LABEL = "Returned useable questionnaire"
NOT_RETURNED_LABELS = ("Not returned, reason unknown", "Returned blank, opted out")
EMERGENCY_LABEL = "Emergency or urgent"
CHOICE_Q10_YES = "Yes"
CHOICE_Q6_NO = "No, but I would have liked a choice"
CHOICE_Q6_LEVELS = ("Yes", CHOICE_Q6_NO, "No, but I did not mind")
DIGNITY_ALWAYS = "Yes, always"
MISSING_DATA_LABEL = "Missing data"

RATING_LEVELS = ("Excellent", "Very good", "Good", "Fair", "Poor")
SATISFACTION_TRI_LABELS = ("Excellent", "Very good", "Other")
SATISFACTION_TRI_ORDERED = ("Other", "Very good", "Excellent")
SATISFACTION_SCORES = (100, 75, 50, 25, 0)
CLEAN_LEVELS = ("Very clean", "Fairly clean", "Not very clean", "Not at all clean")
CLEAN_TRI_ORDERED = ("Other", "Fairly clean", "Very clean")
CONFIDENCE_LEVELS = ("Yes, always", "Yes, sometimes", "No")
CONFIDENCE_ORDERED = ("No", "Yes, sometimes", "Yes, always")
CALL_BUTTON_LEVELS = (
    "0 minutes/ right away",
    "1-2 minutes",
    "3-5 minutes",
    "More than 5 minutes",
    "I never got help when I used the call button ",
)
CALL_BUTTON_ORDERED = (
    "I never got help when I used the call button ",
    "More than 5 minutes",
    "3-5 minutes",
    "1-2 minutes",
    "0 minutes/ right away",
)
AGE_LEVELS = ("16-35", "36-50", "51-65", "66+")
GENDER_LEVELS = ("Male", "Female", "Missing data")
ADMISSION_LEVELS = ("Emergency or urgent", "Waiting list or planned")
STRATA_LEVELS = ("Mail1", "Mail2", "Mail3")
MAILING_LABELS = ("First", "Second", "Third")
# Rating column of each wave.
RATING_COLUMN_BY_WAVE = {2006: "q66", 2007: "q68", 2008: "q71", 2009: "q74"}
# ---------------------------------------------------------------------------

DICTIONARY: dict[str, tuple[str, ...]] = {
    "q74": RATING_LEVELS,
    "q66": RATING_LEVELS,
    "q68": RATING_LEVELS,
    "q71": RATING_LEVELS,
    "q22": CLEAN_LEVELS,
    "q32": CONFIDENCE_LEVELS,
    "q36": CONFIDENCE_LEVELS,
    "q72": CONFIDENCE_LEVELS,
    "q64": CONFIDENCE_LEVELS,
    "q49": CALL_BUTTON_LEVELS,
    "age_group": AGE_LEVELS,
    "all_gender": GENDER_LEVELS,
    "q1": ADMISSION_LEVELS,
    "reply_strata": STRATA_LEVELS,
}

LEVELS_SCHEMA = T.StructType([
    T.StructField("wave", T.IntegerType(), False),
    T.StructField("variable", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
])


def factor_levels(spark: SparkSession, waves=(2006, 2007, 2008, 2009)) -> DataFrame:
    """The level dictionary ``(wave, variable, level, ord)`` as a tiny DataFrame."""
    rows = [
        (w, var, lvl, i + 1)
        for w in waves
        for var, lvls in DICTIONARY.items()
        for i, lvl in enumerate(lvls)
    ]
    return spark.createDataFrame(rows, LEVELS_SCHEMA)
