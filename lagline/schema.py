"""Fixed column lists, labels and parameters of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: column names of the raw event file, in file order -------------------
RAW_COLUMNS = [
    "service_date",
    "transit_system_name",
    "route_name",
    "direction_code",
    "trip_id",
    "vehicle_id",
    "stop_id",
    "stop_name",
    "stop_sequence",
    "scheduled_arrival_time",
    "scheduled_departure_time",
    "actual_arrival_time",
    "actual_departure_time",
    "delay_on_departure_seconds",
    "on_time_performance_deviation_seconds",
    "on_time_performance_status",
]
PROVENANCE = ["source_archive", "source_file", "source_row_number"]
TIMESTAMPS = [c for c in RAW_COLUMNS if c.endswith("_time")]
INTEGERS = ["stop_sequence", "delay_on_departure_seconds", "on_time_performance_deviation_seconds"]
TEXTS = [c for c in RAW_COLUMNS if c not in TIMESTAMPS + INTEGERS + ["service_date"]]
DERIVED_COLUMNS = [
    "event_type",
    "scheduled_event_time",
    "actual_event_time",
    "is_after_midnight_service",
    "has_performance_measurement",
    "has_departure_delay",
]

# ---- Fixed values: feature-table columns ----------------------------------------------
CONTEXT = ["service_date", "scheduled_event_time", "data_split"]
CATEGORICAL = ["route_name", "direction_code", "stop_id", "service_day_of_week"]
NUMERICAL = ["stop_sequence", "scheduled_minute_of_service_day", "service_month_number"]
PREDICTORS = CATEGORICAL + NUMERICAL
TARGET = "departure_delay_seconds"
CLASS_TARGET = "service_status"
# Nothing derived from the outcome, no uncertain identifier and no provenance may predict.
NEVER_PREDICTORS = [
    "actual_arrival_time",
    "actual_departure_time",
    "actual_event_time",
    "delay_on_departure_seconds",
    "on_time_performance_deviation_seconds",
    "on_time_performance_status",
    "has_performance_measurement",
    "has_departure_delay",
    "transit_system_name",
    "trip_id",
    "vehicle_id",
    "stop_name",
    "event_type",
    "source_archive",
    "source_file",
    "source_row_number",
]

# ---- Fixed values: labels --------------------------------------------------------------
STATUSES = ["Very Early", "Early", "On Time", "Late", "Very Late"]
# Upper bound in whole seconds, inclusive, of every band but the last.
STATUS_UPPER = {"Very Early": -180, "Early": -60, "On Time": 180, "Late": 360}
STATUS_TO_CLASS = {
    "Very Early": "Early",
    "Early": "Early",
    "On Time": "On Time",
    "Late": "Late",
    "Very Late": "Late",
}
MISSING = "<MISSING>"
# Tokens that a delimited file uses for "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- Fixed values: calendar of the chronological comparison -----------------------------
VALIDATION_START = "2026-05-01"
TEST_START = "2026-06-01"
DEVELOPMENT_MONTHS = ["2026-03-01", "2026-04-01", "2026-05-01"]
AUDIT_MONTH = "2026-06-01"
CROSS_FIT_MONTHS = ["2026-02-01", "2026-03-01", "2026-04-01", "2026-05-01", "2026-06-01"]
FINAL_CUTOFF = "2026-07-03"
EMBARGO_DAYS = 2

# ---- Fixed values: probability levels ---------------------------------------------------
PROFILE_LEVELS = [0.0, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0]
DIFFERENCE_LEVELS = [0.0, 0.5, 0.95, 0.99, 1.0]

RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def _typed(name: str) -> T.DataType:
    if name == "service_date":
        return T.DateType()
    if name in TIMESTAMPS or name in ("scheduled_event_time", "actual_event_time"):
        # The supplied clock is used as it is, so the type without a zone fits: no session
        # setting can shift it.
        return T.TimestampNTZType()
    if name in INTEGERS or name == "source_row_number":
        return T.LongType()
    if name.startswith(("is_", "has_")):
        return T.BooleanType()
    return T.StringType()


EVENT_SCHEMA = T.StructType([T.StructField(c, _typed(c)) for c in PROVENANCE + RAW_COLUMNS])
CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, _typed(c)) for c in PROVENANCE + RAW_COLUMNS + DERIVED_COLUMNS]
)


def adapt(df, names: dict[str, str]):
    """Rename a user's columns (``{theirs: ours}``) to the names used here."""
    return df.withColumnsRenamed(names)
