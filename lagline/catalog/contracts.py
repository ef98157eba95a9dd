"""Scans, sinks' aggregates, parsing and data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog.prelude import band, over, real, whole
from lagline.catalog.registry import clean, features, query, raw
from lagline.functions import columns as C
from lagline.operators import contracts as Q
from lagline.operators import events as E
from lagline.sources.footers import table_facts
from lagline.sources.lineitem import faulty_events, text_events
from lagline.sources.reports import departure_range, manifest


@query(
    "s10_manifest",
    over(
        "raw",
        f"""SELECT coalesce(source_archive, '*') AS source_archive, coalesce(source_file, '*') AS source_file,
        {whole('count(*)', 'rows')}, min(service_date) AS minimum_service_date, max(service_date) AS maximum_service_date
        FROM raw GROUP BY ROLLUP (source_archive, source_file)""",
    ), text=("minimum_service_date", "maximum_service_date",))
def _(spark, folder):
    return manifest(raw(spark, folder))


@query(
    "s11_column_subset",
    over("clean", "SELECT service_date, route_name, scheduled_event_time, delay_on_departure_seconds FROM clean"), text=("service_date", "delay_on_departure_seconds",))
def _(spark, folder):
    return clean(spark, folder).select(
        "service_date", "route_name", "scheduled_event_time", "delay_on_departure_seconds"
    )


@query(
    "s12_load_split",
    over("feat", "SELECT * EXCLUDE (weekday, day_type, month) FROM feat WHERE data_split = 'validation'"), text=("service_date",))
def _(spark, folder):
    return E.regression_features(clean(spark, folder)).where(F.col("data_split") == "validation")


@query("s13_full_scan", over("clean", "SELECT * FROM clean"), text=("service_date", "delay_on_departure_seconds", "on_time_performance_deviation_seconds",))
def _(spark, folder):
    return clean(spark, folder)


@query(
    "s16_departure_date_range",
    over(
        "clean",
        "SELECT min(service_date) AS departure_date_min, max(service_date) AS departure_date_max "
        "FROM clean WHERE event_type = 'departure'",
    ), text=("departure_date_min", "departure_date_max",))
def _(spark, folder):
    return departure_range(clean(spark, folder))


@query("s21_size_facts", over("clean", f"SELECT {whole('count(*)', 'rows')}, {whole('25', 'columns')} FROM clean"))
def _(spark, folder):
    table = clean(spark, folder)
    return table.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(table.columns)).cast("bigint").alias("columns"))


@query(
    "s21b_footer_facts",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(1 AS BIGINT) AS schemas,
    CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS BIGINT) AS columns,
    strftime(min(l_shipdate), '%Y-%m-%d') AS low, strftime(max(l_shipdate), '%Y-%m-%d') AS high FROM lineitem""",
)
def _(spark, folder):
    """Size, schema and date range of a stored table, from its footers."""
    return table_facts(spark, f"{folder}/lineitem.parquet", "l_shipdate").select(
        "rows", "schemas", F.size(F.split("columns", ", ")).cast("bigint").alias("columns"),
        F.date_format("low", "yyyy-MM-dd").alias("low"), F.date_format("high", "yyyy-MM-dd").alias("high"),
    )


_PARSED_DATE = (
    "CASE WHEN regexp_full_match(service_date, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') "
    "THEN CAST(try_strptime(service_date, '%m/%d/%Y') AS DATE) END"
)
_PARSED_TIME = (
    "CASE WHEN regexp_full_match(scheduled_departure_time, "
    "'[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}[.][0-9]{1,9}Z') "
    "THEN try_cast(replace(replace(scheduled_departure_time, 'T', ' '), 'Z', '') AS TIMESTAMP) END"
)
_PARSED_INT = (
    "CASE WHEN try_cast(stop_sequence AS DOUBLE) = floor(try_cast(stop_sequence AS DOUBLE)) "
    "THEN CAST(try_cast(stop_sequence AS DOUBLE) AS BIGINT) END"
)
_PARSED_DELAY = "try_cast(delay_on_departure_seconds AS BIGINT)"


@query(
    "q1_parse_date",
    over(
        "txt",
        f"""SELECT {_PARSED_DATE} AS service_date, {whole('count(*)', 'rows')},
        {whole(f'sum(CASE WHEN service_date IS NOT NULL AND {_PARSED_DATE} IS NULL THEN 1 ELSE 0 END)', 'unreadable')}
        FROM txt GROUP BY {_PARSED_DATE}""",
    ), text=("service_date",))
def _(spark, folder):
    text = text_events(raw(spark, folder))
    bad = Q.parse_rules()["service_date"]
    return (
        text.select(bad.alias("bad"), Q.parsers()["service_date"].alias("service_date"))
        .groupBy("service_date")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("unreadable"))
    )


@query(
    "q2_parse_timestamp",
    over(
        "txt",
        f"""SELECT source_archive, source_file, source_row_number, {_PARSED_TIME} AS scheduled_departure_time,
        scheduled_departure_time IS NOT NULL AND {_PARSED_TIME} IS NULL AS unreadable FROM txt""",
    ),
)
def _(spark, folder):
    text = text_events(raw(spark, folder))
    return text.select(
        *S.PROVENANCE,
        Q.parsers()["scheduled_departure_time"].alias("scheduled_departure_time"),
        Q.parse_rules()["scheduled_departure_time"].alias("unreadable"),
    )


@query(
    "q3_parse_integer",
    over(
        "txt",
        f"""SELECT {_PARSED_INT} AS stop_sequence, {whole('count(*)', 'rows')},
        {whole(f'sum(CASE WHEN stop_sequence IS NOT NULL AND {_PARSED_INT} IS NULL THEN 1 ELSE 0 END)', 'unreadable')},
        {whole(f'sum({_PARSED_DELAY})', 'delay_sum')}
        FROM txt GROUP BY {_PARSED_INT}""",
    ), text=("stop_sequence", "delay_sum",))
def _(spark, folder):
    text = text_events(raw(spark, folder))
    typed = Q.parsers()
    return (
        text.select(
            typed["stop_sequence"].alias("stop_sequence"),
            typed["delay_on_departure_seconds"].alias("delay"),
            Q.parse_rules()["stop_sequence"].alias("bad"),
        )
        .groupBy("stop_sequence")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("unreadable"), F.sum("delay").alias("delay_sum"))
    )


@query(
    "q4_first_offending_rows",
    over(
        "txt",
        """SELECT rule, source_archive, source_file,
        array_to_string(list(source_row_number ORDER BY source_row_number), ',') AS rows
        FROM ranked WHERE position <= 5 GROUP BY rule, source_archive, source_file""",
        f"""bad AS (
        SELECT 'service_date' AS rule, source_archive, source_file, source_row_number FROM txt
          WHERE service_date IS NOT NULL AND {_PARSED_DATE} IS NULL
        UNION ALL SELECT 'scheduled_departure_time', source_archive, source_file, source_row_number FROM txt
          WHERE scheduled_departure_time IS NOT NULL AND {_PARSED_TIME} IS NULL
        UNION ALL SELECT 'stop_sequence', source_archive, source_file, source_row_number FROM txt
          WHERE {_PARSED_INT} IS NULL
        UNION ALL SELECT 'delay_on_departure_seconds', source_archive, source_file, source_row_number FROM txt
          WHERE delay_on_departure_seconds NOT IN ('NA') AND {_PARSED_DELAY} IS NULL)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY rule, source_archive, source_file
        ORDER BY source_row_number) AS position FROM bad)""",
    ),
)
def _(spark, folder):
    text = text_events(raw(spark, folder))
    sampled = Q.sample_violations(text, Q.parse_rules())
    return sampled.withColumn("rows", F.array_join("rows", ","))


_TEXTS = [c for c in S.TEXTS]
_OUTER = " OR ".join(rf"coalesce(regexp_matches({c}, '^\s|\s$'), false)" for c in _TEXTS)
_CONTROL = " OR ".join(rf"coalesce(regexp_matches({c}, '[\r\n\t]'), false)" for c in _TEXTS)
_SCHEDULED = "CASE WHEN scheduled_departure_time IS NOT NULL THEN scheduled_departure_time ELSE scheduled_arrival_time END"
_ACTUAL = "CASE WHEN scheduled_departure_time IS NOT NULL THEN actual_departure_time ELSE actual_arrival_time END"
_DEV, _STATUS = "on_time_performance_deviation_seconds", "on_time_performance_status"
_RULES = {
    "q7_outer_whitespace": ("outer_whitespace", _OUTER),
    "q8_control_whitespace": ("control_whitespace", _CONTROL),
    "q9_one_scheduled_time": (
        "one_scheduled_time",
        "(scheduled_arrival_time IS NULL) = (scheduled_departure_time IS NULL)",
    ),
    "q10_missing_together": (
        "deviation_and_status_missing_together",
        f"({_DEV} IS NULL) <> ({_STATUS} IS NULL)",
    ),
    "q10b_actual_missing_together": (
        "deviation_and_actual_missing_together",
        f"({_DEV} IS NULL) <> (({_ACTUAL}) IS NULL)",
    ),
    "q11_status_matches_band": (
        "status_matches_deviation",
        f"{_STATUS} IS DISTINCT FROM ({band(_DEV)})",
    ),
    "q12_deviation_matches_times": (
        "deviation_matches_times",
        f"({_ACTUAL}) IS NOT NULL AND date_diff('second', ({_SCHEDULED}), ({_ACTUAL})) IS DISTINCT FROM {_DEV}",
    ),
    "q13_service_day_or_next": (
        "service_day_or_next",
        f"coalesce(date_diff('day', service_date, CAST(({_SCHEDULED}) AS DATE)), -1) NOT IN (0, 1)",
    ),
}


def _rule_query(name: str, rule: str):
    def build(spark, folder):
        return Q.count_violations(faulty_events(raw(spark, folder)), {rule: Q.event_rules()[rule]})

    query(
        name,
        over(
            "faulty",
            f"SELECT '{rule}' AS rule, {whole(f'count(*) FILTER (WHERE {_RULES[name][1]})', 'violations')} FROM faulty",
        ),
    )(build)


for _name, (_rule, _) in _RULES.items():
    _rule_query(_name, _rule)


@query(
    "q_all_rules_one_pass",
    over(
        "faulty",
        " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, {whole(f'count(*) FILTER (WHERE {test})', 'violations')} FROM faulty"
            for rule, test in _RULES.values()
        ),
    ),
)
def _(spark, folder):
    return Q.count_violations(faulty_events(raw(spark, folder)), Q.event_rules())


@query(
    "q14_unexpected_statuses",
    over(
        "faulty",
        f"""SELECT {_STATUS} AS status, {whole('count(*)', 'rows')} FROM faulty
        WHERE {_STATUS} NOT IN ('Very Early', 'Early', 'On Time', 'Late', 'Very Late') GROUP BY {_STATUS}""",
    ),
)
def _(spark, folder):
    return Q.unexpected_statuses(faulty_events(raw(spark, folder)))


@query(
    "q15_split_guards",
    over(
        "feat",
        f"""SELECT data_split, {whole('count(*)', 'rows')},
        {whole('count(*) - count(departure_delay_seconds)', 'missing_target')} FROM feat GROUP BY data_split""",
    ),
)
def _(spark, folder):
    return (
        features(spark, folder)
        .groupBy("data_split")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(Q.split_rules()["missing_target"]).alias("missing_target"))
    )


@query(
    "q16_cleaning_counters",
    over(
        "clean",
        f"""SELECT {whole("count(*) FILTER (WHERE event_type = 'arrival')", 'arrival_events')},
        {whole("count(*) FILTER (WHERE event_type = 'departure')", 'departure_events')},
        {whole('count(*) FILTER (WHERE is_after_midnight_service)', 'after_midnight_events')},
        {whole('count(on_time_performance_deviation_seconds)', 'performance_measurements_available')},
        {whole('count(delay_on_departure_seconds)', 'departure_delays_available')},
        {whole('count(*) - count(direction_code)', 'rows_with_missing_direction')},
        {whole('count(*) FILTER (WHERE actual_departure_time IS NOT NULL AND delay_on_departure_seconds IS NULL)',
               'rows_with_actual_departure_but_missing_departure_delay')} FROM clean""",
    ),
)
def _(spark, folder):
    return Q.cleaning_counters(clean(spark, folder))


@query(
    "q17_feature_counters",
    over(
        "feat",
        f"""SELECT 'rows' AS counter, {whole('count(*)', 'rows')} FROM cls
        UNION ALL SELECT 'split_' || data_split, count(*) FROM cls GROUP BY data_split
        UNION ALL SELECT 'class_' || service_status, count(*) FROM cls GROUP BY service_status
        UNION ALL SELECT 'missing_direction', count(*) FROM cls WHERE direction_code IS NULL""",
    ),
)
def _(spark, folder):
    table = E.classification_features(clean(spark, folder))
    return Q.feature_counters(table, S.CLASS_TARGET, classes=True)


@query(
    "q18_not_empty",
    over(
        "feat",
        f"""SELECT 'regression' AS table_name, {whole('count(*)', 'rows')}, count(*) = 0 AS empty FROM reg
        UNION ALL SELECT 'classification', count(*), count(*) = 0 FROM cls""",
    ),
)
def _(spark, folder):
    table = clean(spark, folder)
    n = F.count(F.lit(1))

    def facts(frame, name):
        return frame.agg(F.lit(name).alias("table_name"), n.alias("rows"), (n == 0).alias("empty"))

    return facts(E.regression_features(table), "regression").unionByName(
        facts(E.classification_features(table), "classification")
    )


@query(
    "q19_values_preserved",
    over(
        "clean",
        f"""SELECT {whole('count(*)', 'rows_changed')} FROM (
        (SELECT {', '.join(S.PROVENANCE + S.RAW_COLUMNS)} FROM raw EXCEPT ALL SELECT {', '.join(S.PROVENANCE + S.RAW_COLUMNS)} FROM clean)
        UNION ALL
        (SELECT {', '.join(S.PROVENANCE + S.RAW_COLUMNS)} FROM clean EXCEPT ALL SELECT {', '.join(S.PROVENANCE + S.RAW_COLUMNS)} FROM raw))""",
    ),
)
def _(spark, folder):
    return Q.changed_rows(raw(spark, folder), clean(spark, folder), S.PROVENANCE + S.RAW_COLUMNS)
