"""SQL restatement of the event model, for the independent checks.

Each check is one statement that starts from the given tables. The common table
expressions here are prepended as far as a statement needs them.
"""

from __future__ import annotations

ITEMS = """
items AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln,
         CAST(l_shipdate AS DATE) AS shipped
  FROM lineitem
)"""

SHAPED = """
shaped AS (
  SELECT *,
    CAST(DATE '2026-01-01' + CAST(date_diff('day', DATE '1995-01-01', shipped) % 181 AS INTEGER) AS DATE) AS service_date,
    CASE WHEN sk % 10 <= 4 THEN '1' WHEN sk % 10 <= 7 THEN '4' WHEN sk % 10 = 8 THEN '70' ELSE 'X1' END AS route_name,
    360 + CASE WHEN ((ok * 7919 + ln * 104729) % 1140) % 40 = 0 THEN (ok * 7919 + ln * 104729) % 1140
               ELSE (((ok * 7919 + ln * 104729) % 1140) % 8) * 60 + ((ok * 7919 + ln * 104729) % 1140) % 7 END AS minute,
    CASE WHEN pk % 200 = 0 THEN 99 ELSE pk % 4 END AS stop_number
  FROM items
)"""

MEASURED = """
base AS (
  SELECT *, (pk * 31 + ok * 17 + ln * 7) % 541 - 150
    + CASE route_name WHEN '1' THEN 60 WHEN '4' THEN 0 WHEN '70' THEN 300 ELSE 120 END
    + CASE WHEN minute BETWEEN 900 AND 959 THEN 45 ELSE 0 END
    + CASE WHEN pk % 997 = 0 THEN 3000 ELSE 0 END AS base
  FROM shaped
),
measured AS (
  SELECT *,
    CASE WHEN ok % 1000 <> 7 THEN base END AS deviation,
    CASE WHEN ok % 1000 <> 7 AND ln <> 7 THEN base + pk % 9 - 4 END AS delay,
    CAST(service_date AS TIMESTAMP) + to_minutes(CAST(minute AS BIGINT)) AS scheduled
  FROM base
)"""


def band(deviation: str) -> str:
    return (
        f"CASE WHEN {deviation} <= -180 THEN 'Very Early' WHEN {deviation} <= -60 THEN 'Early' "
        f"WHEN {deviation} <= 180 THEN 'On Time' WHEN {deviation} <= 360 THEN 'Late' "
        f"WHEN {deviation} IS NOT NULL THEN 'Very Late' END"
    )


RAW = f"""
raw AS (
  SELECT 'supplier-' || sk || '.zip' AS source_archive,
    strftime(shipped, '%Y-%m-%d') || '.csv' AS source_file,
    (ok * 10 + ln) * 1000000 + pk % 1000000 AS source_row_number,
    service_date,
    'Example Transit' AS transit_system_name,
    route_name,
    CASE WHEN sk % 23 = 0 THEN NULL WHEN ok % 2 = 0 THEN 'Inbound' ELSE 'Outbound' END AS direction_code,
    CASE WHEN ok % 5 = 0 THEN (ok % 97) || '.5E+11' ELSE CAST(ok AS VARCHAR) END AS trip_id,
    'v' || sk AS vehicle_id,
    route_name || '-' || stop_number AS stop_id,
    'Stop ' || stop_number || CASE WHEN pk % 400 = 0 THEN ' North' ELSE '' END AS stop_name,
    ln AS stop_sequence,
    CASE WHEN ln = 7 THEN scheduled END AS scheduled_arrival_time,
    CASE WHEN ln <> 7 THEN scheduled END AS scheduled_departure_time,
    CASE WHEN ln = 7 THEN scheduled + to_seconds(deviation)
         WHEN deviation IS NULL AND ok % 2 = 1 THEN scheduled + to_seconds(30) END AS actual_arrival_time,
    CASE WHEN ln <> 7 THEN scheduled + to_seconds(deviation)
         WHEN ok % 2 = 0 THEN scheduled + to_seconds(30) END AS actual_departure_time,
    delay AS delay_on_departure_seconds,
    deviation AS on_time_performance_deviation_seconds,
    {band('deviation')} AS on_time_performance_status
  FROM measured
)"""

CLEAN = """
typed AS (
  SELECT *,
    CASE WHEN scheduled_arrival_time IS NOT NULL THEN 'arrival' ELSE 'departure' END AS event_type,
    CASE WHEN scheduled_departure_time IS NOT NULL THEN scheduled_departure_time ELSE scheduled_arrival_time END AS scheduled_event_time,
    CASE WHEN scheduled_departure_time IS NOT NULL THEN actual_departure_time ELSE actual_arrival_time END AS actual_event_time
  FROM raw
),
clean AS (
  SELECT *,
    date_diff('day', service_date, CAST(scheduled_event_time AS DATE)) = 1 AS is_after_midnight_service,
    on_time_performance_deviation_seconds IS NOT NULL AS has_performance_measurement,
    delay_on_departure_seconds IS NOT NULL AS has_departure_delay
  FROM typed
)"""

CALENDAR = """
cal AS (
  SELECT *,
    CAST(hour(scheduled_event_time) AS INTEGER) AS scheduled_hour,
    CAST(isodow(service_date) - 1 AS INTEGER) AS weekday_number,
    dayname(service_date) AS weekday,
    CAST(month(service_date) AS INTEGER) AS month_number,
    monthname(service_date) AS month,
    CASE WHEN isodow(service_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS period_group,
    on_time_performance_status IN ('Very Early', 'Early') AS is_early,
    on_time_performance_status = 'On Time' AS is_on_time,
    on_time_performance_status IN ('Late', 'Very Late') AS is_late
  FROM clean WHERE has_performance_measurement
)"""

FEATURES = """
common AS (
  SELECT source_archive || '|' || source_file || '|' || source_row_number AS event_key,
    service_date, scheduled_event_time,
    CASE WHEN service_date >= DATE '2026-06-01' THEN 'test'
         WHEN service_date >= DATE '2026-05-01' THEN 'validation' ELSE 'train' END AS data_split,
    route_name, direction_code, stop_id, dayname(service_date) AS service_day_of_week, stop_sequence,
    CAST(hour(scheduled_event_time) * 60 + minute(scheduled_event_time)
         + CASE WHEN is_after_midnight_service THEN 1440 ELSE 0 END AS INTEGER) AS scheduled_minute_of_service_day,
    CAST(month(service_date) AS INTEGER) AS service_month_number,
    delay_on_departure_seconds AS departure_delay_seconds,
    CASE on_time_performance_status WHEN 'Very Early' THEN 'Early' WHEN 'Early' THEN 'Early'
         WHEN 'On Time' THEN 'On Time' WHEN 'Late' THEN 'Late' WHEN 'Very Late' THEN 'Late' END AS service_status,
    on_time_performance_status
  FROM clean WHERE event_type = 'departure'
),
reg AS (
  SELECT event_key, service_date, scheduled_event_time, data_split, route_name, direction_code, stop_id,
    service_day_of_week, stop_sequence, scheduled_minute_of_service_day, service_month_number, departure_delay_seconds
  FROM common WHERE departure_delay_seconds IS NOT NULL
),
cls AS (
  SELECT event_key, service_date, scheduled_event_time, data_split, route_name, direction_code, stop_id,
    service_day_of_week, stop_sequence, scheduled_minute_of_service_day, service_month_number, service_status
  FROM common WHERE on_time_performance_status IS NOT NULL
),
feat AS (
  SELECT *, CAST(isodow(service_date) - 1 AS INTEGER) AS weekday,
    CAST(greatest(isodow(service_date) - 5, 0) AS INTEGER) AS day_type,
    CAST(date_trunc('month', service_date) AS DATE) AS month
  FROM reg
)"""

FAULTY = """
faulty AS (
  SELECT source_archive, source_file, source_row_number,
    CASE WHEN r = 19 THEN CAST(service_date - INTERVAL 2 DAY AS DATE) ELSE service_date END AS service_date,
    transit_system_name, route_name,
    CASE WHEN r = 29 THEN 'In' || chr(9) || direction_code ELSE direction_code END AS direction_code,
    trip_id, vehicle_id, stop_id,
    CASE WHEN r = 23 THEN stop_name || ' ' ELSE stop_name END AS stop_name,
    stop_sequence,
    CASE WHEN r = 3 THEN scheduled_departure_time ELSE scheduled_arrival_time END AS scheduled_arrival_time,
    CASE WHEN r = 5 THEN NULL ELSE scheduled_departure_time END AS scheduled_departure_time,
    actual_arrival_time, actual_departure_time, delay_on_departure_seconds,
    CASE WHEN r = 7 THEN on_time_performance_deviation_seconds + 1
         WHEN r = 11 THEN NULL ELSE on_time_performance_deviation_seconds END AS on_time_performance_deviation_seconds,
    CASE WHEN r = 13 THEN 'Late' WHEN r = 17 THEN 'Delayed' ELSE on_time_performance_status END AS on_time_performance_status
  FROM (SELECT *, (source_row_number // 1000000) % 101 AS r FROM raw)
)"""

TEXT = """
txt AS (
  SELECT source_archive, source_file, source_row_number,
    CASE WHEN r = 2 THEN '31/31/2026'
         ELSE month(service_date) || '/' || day(service_date) || '/' || year(service_date) END AS service_date,
    CASE WHEN r = 4 THEN strftime(scheduled_departure_time, '%Y-%m-%d %H:%M:%S')
         ELSE strftime(scheduled_departure_time, '%Y-%m-%dT%H:%M:%S.%gZ') END AS scheduled_departure_time,
    strftime(scheduled_arrival_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS scheduled_arrival_time,
    CASE WHEN r = 6 THEN '12.5' WHEN r = 8 THEN stop_sequence || '.0' WHEN r = 9 THEN '2e1'
         ELSE CAST(stop_sequence AS VARCHAR) END AS stop_sequence,
    CASE WHEN r = 10 THEN 'soon' WHEN delay_on_departure_seconds IS NULL THEN 'NA'
         ELSE CAST(delay_on_departure_seconds AS VARCHAR) END AS delay_on_departure_seconds
  FROM (SELECT *, (source_row_number // 1000000) % 103 AS r FROM raw)
)"""

_CHAIN = [ITEMS, SHAPED, MEASURED, RAW]
STAGES = {
    "raw": _CHAIN,
    "faulty": [*_CHAIN, FAULTY],
    "txt": [*_CHAIN, TEXT],
    "clean": [*_CHAIN, CLEAN],
    "cal": [*_CHAIN, CLEAN, CALENDAR],
    "feat": [*_CHAIN, CLEAN, FEATURES],
}


def over(stage: str, select: str, *more: str) -> str:
    """A statement over a stage; ``more`` are further table expressions ``name AS (...)``."""
    return "WITH " + ",".join([*STAGES[stage], *more]) + "\n" + select


def real(expression: str, alias: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {alias}"


def whole(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"
