"""Scalar expressions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog.prelude import band, over, real, whole
from lagline.catalog.registry import clean, features, query, raw
from lagline.functions import columns as C
from lagline.operators import events as E

_ID = "source_archive, source_file, source_row_number"


def _of_clean(name: str, sql: str, build, stage: str = "clean", text: tuple[str, ...] = ()):
    """One derived value per clean event, with its provenance."""

    def run(spark, folder):
        return clean(spark, folder).select(*S.PROVENANCE, *build())

    query(name, over(stage, f"SELECT {_ID}, {sql} FROM {stage}"), text)(run)


def _of_features(name: str, sql: str, build):
    def run(spark, folder):
        return features(spark, folder).select("event_key", *build())

    query(name, over("feat", f"SELECT event_key, {sql} FROM feat"))(run)


_of_clean("p1_event_type", "event_type", lambda: ["event_type"])
_of_clean(
    "p2_event_times", "scheduled_event_time, actual_event_time", lambda: ["scheduled_event_time", "actual_event_time"]
)
_of_clean(
    "p3_status_band",
    f"{band('on_time_performance_deviation_seconds')} AS status",
    lambda: [C.status_band(F.col("on_time_performance_deviation_seconds")).alias("status")],
)
_of_clean(
    "p4_flags",
    "is_after_midnight_service, has_performance_measurement, has_departure_delay",
    lambda: ["is_after_midnight_service", "has_performance_measurement", "has_departure_delay"],
)
_of_clean(
    "p5_clock_without_shift",
    "CAST(scheduled_event_time AS DATE) AS clock_date, CAST(hour(scheduled_event_time) * 60 + minute(scheduled_event_time) AS INTEGER) AS clock_minute",
    lambda: [
        F.col("scheduled_event_time").cast("date").alias("clock_date"),
        (F.hour("scheduled_event_time") * 60 + F.minute("scheduled_event_time")).alias("clock_minute"),
    ],
)


@query("p6_departures", over("clean", f"SELECT {_ID}, route_name FROM clean WHERE event_type = 'departure'"))
def _(spark, folder):
    return clean(spark, folder).where(F.col("event_type") == "departure").select(*S.PROVENANCE, "route_name")


_of_features("p7_split", "data_split", lambda: ["data_split"])
_of_clean(
    "p8_calendar_names",
    """dayname(service_date) AS weekday_name, CAST(isodow(service_date) - 1 AS INTEGER) AS weekday_number,
    CAST(month(service_date) AS INTEGER) AS month_number, monthname(service_date) AS month_name""",
    lambda: [
        C.weekday_name(F.col("service_date")).alias("weekday_name"),
        C.weekday_number(F.col("service_date")).alias("weekday_number"),
        F.month("service_date").alias("month_number"),
        C.month_name(F.col("service_date")).alias("month_name"),
    ],
)
_of_features("p9_minute_of_service_day", "scheduled_minute_of_service_day", lambda: ["scheduled_minute_of_service_day"])
_of_clean(
    "p10_wall_clock_hour",
    "CAST(hour(scheduled_event_time) AS INTEGER) AS scheduled_hour",
    lambda: [C.wall_clock_hour(F.col("scheduled_event_time")).alias("scheduled_hour")],
)
_of_clean(
    "p11_period_group",
    "CASE WHEN isodow(service_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS period_group",
    lambda: [C.period_group(F.col("service_date")).alias("period_group")],
)
_of_features("p12_day_type", "day_type", lambda: ["day_type"])
_of_features(
    "p13_slot",
    "CAST(scheduled_minute_of_service_day // 15 AS INTEGER) AS slot, day_type AS day_key",
    lambda: [C.slot(F.col("scheduled_minute_of_service_day"), 15).alias("slot"), F.col("day_type").alias("day_key")],
)
_of_features(
    "p14_service_hour",
    "CAST(scheduled_minute_of_service_day // 60 AS INTEGER) AS service_hour",
    lambda: [C.service_hour(F.col("scheduled_minute_of_service_day")).alias("service_hour")],
)


@query("p15_service_class", over("feat", "SELECT event_key, service_status FROM cls"))
def _(spark, folder):
    return E.classification_features(clean(spark, folder)).select("event_key", "service_status")


@query("p16_punctuality_flags", over("cal", f"SELECT {_ID}, is_early, is_on_time, is_late FROM cal"))
def _(spark, folder):
    status = F.col("on_time_performance_status")
    return (
        clean(spark, folder)
        .where("has_performance_measurement")
        .select(
            *S.PROVENANCE,
            C.is_early(status).alias("is_early"),
            C.is_on_time(status).alias("is_on_time"),
            C.is_late(status).alias("is_late"),
        )
    )


@query(
    "p17_eligibility",
    over(
        "clean",
        f"""SELECT {whole('count(*)', 'departures')}, {whole('count(delay_on_departure_seconds)', 'with_delay')},
        {whole('count(on_time_performance_status)', 'with_status')} FROM clean WHERE event_type = 'departure'""",
    ),
)
def _(spark, folder):
    return clean(spark, folder).where(F.col("event_type") == "departure").agg(
        F.count(F.lit(1)).alias("departures"),
        F.count("delay_on_departure_seconds").alias("with_delay"),
        F.count("on_time_performance_status").alias("with_status"),
    )


@query("p18_regression_features", over("feat", "SELECT * FROM reg"), text=("service_date",))
def _(spark, folder):
    return E.regression_features(clean(spark, folder))


@query("p18b_classification_features", over("feat", "SELECT * FROM cls"), text=("service_date",))
def _(spark, folder):
    return E.classification_features(clean(spark, folder))


_of_features(
    "p19_prepared_predictors",
    """coalesce(direction_code, '<MISSING>') AS direction_code, CAST(stop_sequence AS DOUBLE) AS stop_sequence""",
    lambda: [
        C.filled(F.col("direction_code")).alias("direction_code"),
        F.col("stop_sequence").cast("double").alias("stop_sequence"),
    ],
)
_of_features(
    "p20_error_flags",
    """abs(departure_delay_seconds - 180) AS error, abs(departure_delay_seconds - 180) <= 60 AS within60,
    abs(departure_delay_seconds - 180) <= 120 AS within120""",
    lambda: [
        F.abs(F.col(S.TARGET) - 180).alias("error"),
        (F.abs(F.col(S.TARGET) - 180) <= 60).alias("within60"),
        (F.abs(F.col(S.TARGET) - 180) <= 120).alias("within120"),
    ],
)


@query(
    "p21_log_support",
    over("feat", f"SELECT stop_id, {real('ln(1 + count(*))', 'support_log')} FROM feat GROUP BY stop_id"),
)
def _(spark, folder):
    return features(spark, folder).groupBy("stop_id").agg(F.log1p(F.count(F.lit(1))).alias("support_log"))


_of_features(
    "p22_blend",
    real("0.75 * departure_delay_seconds + 0.25 * scheduled_minute_of_service_day", "blend"),
    lambda: [C.blend(F.lit(0.75), F.col(S.TARGET), F.col("scheduled_minute_of_service_day")).alias("blend")],
)


@query(
    "p23_published_rounding",
    over(
        "feat",
        """SELECT route_name, round(avg(departure_delay_seconds), 3) AS three, round(avg(departure_delay_seconds), 4) AS four,
        round(avg(departure_delay_seconds), 6) AS six FROM feat GROUP BY route_name""",
    ),
)
def _(spark, folder):
    mean = F.avg(S.TARGET)
    return features(spark, folder).groupBy("route_name").agg(
        F.round(mean, 3).alias("three"), F.round(mean, 4).alias("four"), F.round(mean, 6).alias("six")
    )


_of_features(
    "p24_minutes",
    real("departure_delay_seconds / 60.0", "delay_minutes"),
    lambda: [(F.col(S.TARGET) / 60).alias("delay_minutes")],
)


@query(
    "p25_natural_route_order",
    over(
        "clean",
        """SELECT route_name, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_full_match(route_name, '[0-9]+') THEN 0 ELSE 1 END,
        try_cast(route_name AS BIGINT), route_name) AS INTEGER) AS place FROM (SELECT DISTINCT route_name FROM clean)""",
    ),
)
def _(spark, folder):
    from pyspark.sql import Window

    routes = clean(spark, folder).select("route_name").distinct()
    # one row per route
    return routes.withColumn("place", F.row_number().over(Window.orderBy(*C.natural_order(F.col("route_name")))))


_of_clean(
    "p26_scientific_ids",
    r"regexp_full_match(trip_id, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)[Ee][+-]?[0-9]+') AS scientific",
    lambda: [C.is_scientific(F.col("trip_id")).alias("scientific")],
)
_of_clean(
    "p27_sign",
    "CAST(sign(delay_on_departure_seconds) AS INTEGER) AS delay_sign",
    lambda: [F.signum(F.col("delay_on_departure_seconds").cast("double")).cast("int").alias("delay_sign")],
    text=("delay_sign",),
)


@query(
    "p28_month_predicate",
    over(
        "feat",
        f"""SELECT service_date, {whole('count(*)', 'rows')} FROM feat
        WHERE service_date >= DATE '2026-04-01' AND service_date < DATE '2026-05-01' GROUP BY service_date""",
    ), text=("service_date",))
def _(spark, folder):
    return (
        features(spark, folder)
        .where(C.in_months(F.col("service_date"), "2026-04-01"))
        .groupBy("service_date")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "p29_labels",
    over(
        "cal",
        """SELECT route_name || ' (n=' || format('{:,}', count(*)) || ')' AS label FROM cal GROUP BY route_name""",
    ),
)
def _(spark, folder):
    counts = (
        clean(spark, folder)
        .where("has_performance_measurement")
        .groupBy("route_name")
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return counts.select(C.counted_label(F.col("route_name"), F.col("records")).alias("label"))
