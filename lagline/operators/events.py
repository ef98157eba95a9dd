"""Clean events and feature tables as projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline import schema as S
from lagline.functions import columns as C


def derive(events: DataFrame) -> DataFrame:
    """Append the six analysis columns; supplied columns are never touched."""
    scheduled_departure = F.col("scheduled_departure_time")
    return events.select(
        *S.PROVENANCE,
        *S.RAW_COLUMNS,
        C.event_type(F.col("scheduled_arrival_time")).alias("event_type"),
        C.by_event_type(scheduled_departure, scheduled_departure, F.col("scheduled_arrival_time")).alias(
            "scheduled_event_time"
        ),
        C.by_event_type(
            scheduled_departure, F.col("actual_departure_time"), F.col("actual_arrival_time")
        ).alias("actual_event_time"),
    ).select(
        "*",
        (C.day_offset(F.col("scheduled_event_time"), F.col("service_date")) == 1).alias("is_after_midnight_service"),
        F.col("on_time_performance_deviation_seconds").isNotNull().alias("has_performance_measurement"),
        F.col("delay_on_departure_seconds").isNotNull().alias("has_departure_delay"),
    )


def with_calendar(clean: DataFrame) -> DataFrame:
    """Descriptive calendar fields and punctuality flags for summaries."""
    day, status = F.col("service_date"), F.col("on_time_performance_status")
    return clean.withColumns(
        {
            "scheduled_hour": C.wall_clock_hour(F.col("scheduled_event_time")),
            "weekday_number": C.weekday_number(day),
            "weekday": C.weekday_name(day),
            "month_number": F.month(day),
            "month": C.month_name(day),
            "period_group": C.period_group(day),
            "is_early": C.is_early(status),
            "is_on_time": C.is_on_time(status),
            "is_late": C.is_late(status),
        }
    )


def event_key():
    """Provenance as one value: identifies an event through every later table."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in S.PROVENANCE])


def _common(clean: DataFrame, validation_start: str, test_start: str) -> DataFrame:
    day = F.col("service_date")
    return clean.where(F.col("event_type") == "departure").select(
        event_key().alias("event_key"),
        "service_date",
        "scheduled_event_time",
        C.chronological_split(day, validation_start, test_start).alias("data_split"),
        "route_name",
        "direction_code",
        "stop_id",
        C.weekday_name(day).alias("service_day_of_week"),
        "stop_sequence",
        C.minute_of_service_day(F.col("scheduled_event_time"), F.col("is_after_midnight_service")).alias(
            "scheduled_minute_of_service_day"
        ),
        F.month(day).alias("service_month_number"),
        F.col("delay_on_departure_seconds").alias(S.TARGET),
        C.service_class(F.col("on_time_performance_status")).alias(S.CLASS_TARGET),
        "on_time_performance_status",
    )


def regression_features(
    clean: DataFrame, validation_start: str = S.VALIDATION_START, test_start: str = S.TEST_START
) -> DataFrame:
    """Departures with a known delay: context, predictors, target; nothing else."""
    return (
        _common(clean, validation_start, test_start)
        .where(F.col(S.TARGET).isNotNull())
        .select("event_key", *S.CONTEXT, *S.PREDICTORS, S.TARGET)
    )


def classification_features(
    clean: DataFrame, validation_start: str = S.VALIDATION_START, test_start: str = S.TEST_START
) -> DataFrame:
    return (
        _common(clean, validation_start, test_start)
        .where(F.col("on_time_performance_status").isNotNull())
        .select("event_key", *S.CONTEXT, *S.PREDICTORS, S.CLASS_TARGET)
    )


def with_day_keys(features: DataFrame) -> DataFrame:
    weekday = C.weekday_number(F.col("service_date"))
    return features.withColumn("weekday", weekday).withColumn("day_type", C.day_type(weekday))
