"""Raw events derived from the benchmark's ``lineitem`` table.

Integer arithmetic on the keys only, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.functions.columns import status_band
from lagline.sources.work import spread


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The 19 ingested columns."""
    items = spread(spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
    )).selectExpr(
        "l_orderkey AS ok",
        "l_partkey AS pk",
        "l_suppkey AS sk",
        "CAST(l_linenumber AS BIGINT) AS ln",
        "CAST(l_shipdate AS DATE) AS shipped",
        "(l_orderkey * 7919 + l_linenumber * 104729) % 1140 AS draw",
    )
    # The filters of later steps are pushed into one generated method with all of this, and the JVM
    # only compiles methods under 8,000 bytes: the expressions are kept short. From 900 to 959 the
    # minute is 360 plus a multiple of 40, so draw is 560.
    shaped = items.selectExpr(
        "*",
        "date_add(DATE'2026-01-01', datediff(shipped, DATE'1995-01-01') % 181) AS service_date",
        "CASE WHEN sk % 10 <= 4 THEN '1' WHEN sk % 10 <= 7 THEN '4' WHEN sk % 10 = 8 THEN '70' ELSE 'X1' END AS route_name",
        "CAST(360 + IF(draw % 40 = 0, draw, (draw % 8) * 60 + draw % 7) AS INT) AS minute",
        "IF(pk % 200 = 0, 99, pk % 4) AS stop_number",
    )
    based = shaped.selectExpr(
        "*",
        """(pk * 31 + ok * 17 + ln * 7) % 541 - 150
           + CASE WHEN sk % 10 <= 4 THEN 60 WHEN sk % 10 <= 7 THEN 0 WHEN sk % 10 = 8 THEN 300 ELSE 120 END
           + IF(draw = 560, 45, 0) + IF(pk % 997 = 0, 3000, 0) AS base""",
        "timestampadd(MINUTE, minute, CAST(service_date AS TIMESTAMP_NTZ)) AS scheduled",
    )
    measured = based.selectExpr(
        "*",
        "IF(ok % 1000 = 7, NULL, base) AS deviation",
        "IF(ok % 1000 = 7 OR ln = 7, NULL, base + pk % 9 - 4) AS delay",
    )
    actual = "scheduled + make_dt_interval(0, 0, 0, CAST(deviation AS DECIMAL(18, 6)))"
    # A departure without a measured departure may still have an actual arrival, and an
    # arrival an actual departure: neither counts as the event's own actual time.
    return measured.select(
        *map(
            F.expr,
            [
                "concat('supplier-', sk, '.zip') AS source_archive",
                "concat(CAST(shipped AS STRING), '.csv') AS source_file",
                "(ok * 10 + ln) * 1000000 + pk % 1000000 AS source_row_number",
                "service_date",
                "'Example Transit' AS transit_system_name",
                "route_name",
                "CASE WHEN sk % 23 = 0 THEN NULL WHEN ok % 2 = 0 THEN 'Inbound' ELSE 'Outbound' END AS direction_code",
                "IF(ok % 5 = 0, concat(ok % 97, '.5E+11'), CAST(ok AS STRING)) AS trip_id",
                "concat('v', sk) AS vehicle_id",
                "concat(route_name, '-', stop_number) AS stop_id",
                "concat('Stop ', stop_number, IF(pk % 400 = 0, ' North', '')) AS stop_name",
                "ln AS stop_sequence",
                "IF(ln = 7, scheduled, NULL) AS scheduled_arrival_time",
                "IF(ln <> 7, scheduled, NULL) AS scheduled_departure_time",
                f"""CASE WHEN ln = 7 THEN {actual}
                    WHEN deviation IS NULL AND ok % 2 = 1 THEN scheduled + INTERVAL 30 SECONDS END AS actual_arrival_time""",
                f"""CASE WHEN ln <> 7 THEN {actual}
                    WHEN ok % 2 = 0 THEN scheduled + INTERVAL 30 SECONDS END AS actual_departure_time""",
                "delay AS delay_on_departure_seconds",
                "deviation AS on_time_performance_deviation_seconds",
            ],
        ),
        status_band(F.col("deviation")).alias("on_time_performance_status"),
    )


def faulty_events(events: DataFrame) -> DataFrame:
    """The same events with faults planted by row number, one kind per residue."""
    planted = {
        "scheduled_arrival_time": "IF(r = 3, scheduled_departure_time, scheduled_arrival_time)",
        "scheduled_departure_time": "IF(r = 5, NULL, scheduled_departure_time)",
        "on_time_performance_deviation_seconds": """CASE r WHEN 7 THEN on_time_performance_deviation_seconds + 1
            WHEN 11 THEN NULL ELSE on_time_performance_deviation_seconds END""",
        "on_time_performance_status": "CASE r WHEN 13 THEN 'Late' WHEN 17 THEN 'Delayed' ELSE on_time_performance_status END",
        "service_date": "IF(r = 19, date_sub(service_date, 2), service_date)",
        "stop_name": "IF(r = 23, concat(stop_name, ' '), stop_name)",
        "direction_code": r"IF(r = 29, concat('In\t', direction_code), direction_code)",
    }
    numbered = events.selectExpr("*", "source_row_number div 1000000 % 101 AS r")
    return numbered.selectExpr(
        *[f"{planted.get(c, c)} AS {c}" for c in S.PROVENANCE + S.RAW_COLUMNS]
    )


def text_events(events: DataFrame) -> DataFrame:
    """The events as the text a delimited file would hold, with unreadable values planted."""

    def clock(c: str) -> str:
        return f"""concat(date_format({c}, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z')"""

    text = {c: clock(c) for c in S.TIMESTAMPS}
    text["service_date"] = "IF(r = 2, '31/31/2026', date_format(service_date, 'M/d/yyyy'))"
    text["scheduled_departure_time"] = f"""IF(r = 4, date_format(scheduled_departure_time, 'yyyy-MM-dd HH:mm:ss'),
        {clock('scheduled_departure_time')})"""
    text["stop_sequence"] = """CASE r WHEN 6 THEN '12.5' WHEN 8 THEN concat(stop_sequence, '.0') WHEN 9 THEN '2e1'
        ELSE CAST(stop_sequence AS STRING) END"""
    text["delay_on_departure_seconds"] = """CASE WHEN r = 10 THEN 'soon' WHEN delay_on_departure_seconds IS NULL THEN 'NA'
        ELSE CAST(delay_on_departure_seconds AS STRING) END"""
    text["on_time_performance_deviation_seconds"] = "CAST(on_time_performance_deviation_seconds AS STRING)"
    numbered = events.selectExpr("*", "source_row_number div 1000000 % 103 AS r")
    return numbered.selectExpr(
        *S.PROVENANCE, *[f"{text[c]} AS {c}" if c in text else c for c in S.RAW_COLUMNS]
    )
