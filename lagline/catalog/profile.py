"""Profile of the ingested table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog.prelude import band, over, real, whole
from lagline.catalog.registry import clean, event_table, query, raw
from lagline.operators import profile as A
from lagline.operators import summaries as M

_DELAY, _DEV = A.DELAYS
_STATUS = "on_time_performance_status"
_COLUMNS = S.PROVENANCE + S.RAW_COLUMNS


@query(
    "a4_value_counts",
    over(
        "raw",
        f"""SELECT coalesce(direction_code, '<MISSING>') AS value, {whole('count(*)', 'rows')}
        FROM raw GROUP BY 1""",
    ),
)
def _(spark, folder):
    return A.top_values(raw(spark, folder), "direction_code")


@query(
    "a4b_top_values",
    over(
        "raw",
        f"""SELECT coalesce(vehicle_id, '<MISSING>') AS value, {whole('count(*)', 'rows')}
        FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
)
def _(spark, folder):
    return A.top_values(raw(spark, folder), "vehicle_id", 10)


def _as_text(column: str) -> str:
    if column in S.TIMESTAMPS:
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({column} AS VARCHAR)"


_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_as_text(c)} AS value, source_archive AS pa, source_file AS pf, source_row_number AS pr FROM raw"
    for c in _COLUMNS
) + ")"
_COUNTS = """counts AS (SELECT "column", value, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY 1, 2)"""
_FIRSTS = """firsts AS (SELECT "column", value, min((pa, pf, pr)) AS place FROM cells WHERE value IS NOT NULL GROUP BY 1, 2)"""
_EXAMPLES = """ex AS (SELECT "column", string_agg(value, ' | ' ORDER BY k) AS examples FROM (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY place, value) AS k FROM firsts)
  WHERE k <= 3 GROUP BY 1)"""
_TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS k
  FROM counts) WHERE k = 1)"""


@query(
    "a5_column_profile",
    over(
        "raw",
        f"""SELECT c."column", {whole('coalesce(sum(c.n) FILTER (WHERE c.value IS NOT NULL), 0)', 'non_missing')},
        {whole('coalesce(sum(c.n) FILTER (WHERE c.value IS NULL), 0)', 'missing')},
        {real('100.0 * coalesce(sum(c.n) FILTER (WHERE c.value IS NULL), 0) / sum(c.n)', 'missing_percent')},
        {whole('count(c.value)', 'unique_non_missing')},
        any_value(t.value) AS most_common_value, {whole('any_value(t.n)', 'most_common_count')},
        {real('100.0 * any_value(t.n) / sum(c.n)', 'most_common_percent')}, any_value(e.examples) AS examples
        FROM counts c JOIN top t ON c."column" = t."column" JOIN ex e ON c."column" = e."column" GROUP BY c."column" """,
        _CELLS,
        _COUNTS,
        _FIRSTS,
        _EXAMPLES,
        _TOP,
    ),
)
def column_profile(spark, folder):
    return A.column_profile(event_table(spark, folder), _COLUMNS)


@query(
    "a5b_small_value_counts",
    over(
        "raw",
        """SELECT "column", coalesce(value, '<MISSING>') AS value, n AS rows FROM counts
        WHERE "column" IN (SELECT "column" FROM counts GROUP BY 1 HAVING count(value) <= 25)""",
        _CELLS,
        _COUNTS,
    ),
)
def _(spark, folder):
    return A.small_value_counts(event_table(spark, folder), _COLUMNS)


def _numeric(column: str) -> str:
    quantiles = ", ".join(
        real(f"quantile_cont({column}, {p})", f"q{str(p).replace('.', '_')}") for p in S.PROFILE_LEVELS
    )
    q1, q3 = (f"(SELECT quantile_cont({column}, {p}) FROM raw)" for p in (0.25, 0.75))
    low, high = f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"
    return f"""SELECT '{column}' AS "column", {real(f'min({column})', 'minimum')}, {real(f'max({column})', 'maximum')},
    {real(f'avg({column})', 'mean')}, {quantiles}, {real(low, 'iqr_lower_fence')}, {real(high, 'iqr_upper_fence')},
    {whole(f'count(*) FILTER (WHERE {column} < {low})', 'below_iqr_fence')},
    {whole(f'count(*) FILTER (WHERE {column} > {high})', 'above_iqr_fence')} FROM raw"""


@query("a6_numeric_profile", over("raw", " UNION ALL ".join(map(_numeric, A.DELAYS))))
def _(spark, folder):
    return A.numeric_profile(raw(spark, folder))


@query(
    "a7_timestamp_profile",
    over(
        "raw",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", min({c}) AS minimum, max({c}) AS maximum,
            {whole(f'count(*) FILTER (WHERE hour({c}) BETWEEN 0 AND 4)', 'midnight_to_04_59_count')} FROM raw"""
            for c in S.TIMESTAMPS
        ),
    ),
)
def _(spark, folder):
    return A.timestamp_profile(raw(spark, folder))


@query(
    "a7b_timestamp_offsets",
    over(
        "raw",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", date_diff('day', service_date, CAST({c} AS DATE)) AS day_offset,
            {whole('count(*)', 'rows')} FROM raw GROUP BY 2"""
            for c in S.TIMESTAMPS
        ),
    ), text=("day_offset",))
def _(spark, folder):
    return A.timestamp_offsets(raw(spark, folder))


def _presence(prefix: str) -> str:
    a, d = f"{prefix}_arrival_time", f"{prefix}_departure_time"
    return ", ".join([
        whole(f"count(*) FILTER (WHERE {a} IS NOT NULL AND {d} IS NULL)", f"{prefix}_arrival_only"),
        whole(f"count(*) FILTER (WHERE {a} IS NULL AND {d} IS NOT NULL)", f"{prefix}_departure_only"),
        whole(f"count(*) FILTER (WHERE {a} IS NOT NULL AND {d} IS NOT NULL)", f"{prefix}_both"),
        whole(f"count(*) FILTER (WHERE {a} IS NULL AND {d} IS NULL)", f"{prefix}_neither"),
    ])


@query("a8_presence", over("raw", f"SELECT {_presence('scheduled')}, {_presence('actual')} FROM raw"))
def _(spark, folder):
    return A.presence(raw(spark, folder))


def _levels(value: str, prefix: str) -> str:
    return ", ".join(
        real(f"quantile_cont({value}, {p})", f"{prefix}_q{str(p).replace('.', '_')}") for p in S.DIFFERENCE_LEVELS
    )


_GAPS = f"""gaps AS (SELECT
  scheduled_departure_time IS NOT NULL AND actual_departure_time IS NOT NULL AS d,
  scheduled_arrival_time IS NOT NULL AND actual_arrival_time IS NOT NULL AS a,
  CAST(abs(date_diff('second', scheduled_departure_time, actual_departure_time) - {_DEV}) AS DOUBLE) AS dg,
  CAST(abs(date_diff('second', scheduled_arrival_time, actual_arrival_time) - {_DEV}) AS DOUBLE) AS ag FROM src)"""


@query(
    "a9_computed_deviation",
    over(
        "faulty",
        f"""SELECT {whole('count(*) FILTER (WHERE d)', 'departure_pairs')},
        {whole('count(*) FILTER (WHERE d AND dg = 0)', 'departure_equal')},
        {whole('count(*) FILTER (WHERE d AND dg <= 1)', 'departure_within_one_second')},
        {_levels('dg', 'departure_gap')}, {whole('count(*) FILTER (WHERE a)', 'arrival_pairs')},
        {whole('count(*) FILTER (WHERE a AND ag = 0)', 'arrival_equal')}, {real('max(ag)', 'arrival_gap_maximum')} FROM gaps""",
        _GAPS.replace("src", "faulty"),
    ),
)
def _(spark, folder):
    from lagline.sources.lineitem import faulty_events

    return A.computed_deviation(faulty_events(raw(spark, folder)))


@query(
    "a10_delay_missing",
    over(
        "raw",
        f"""SELECT {whole(f'count(*) FILTER (WHERE {_DELAY} IS NULL AND actual_departure_time IS NOT NULL)', 'rows')} FROM raw""",
    ),
)
def _(spark, folder):
    return A.delay_missing_despite_departure(raw(spark, folder))


@query(
    "a11_two_delays",
    over(
        "raw",
        f"""SELECT {whole('count(*)', 'rows_with_both')}, {whole('count(*) FILTER (WHERE gap = 0)', 'equal')},
        {_levels('gap', 'gap')} FROM (SELECT abs({_DELAY} - {_DEV}) AS gap FROM raw
        WHERE {_DELAY} IS NOT NULL AND {_DEV} IS NOT NULL)""",
    ),
)
def _(spark, folder):
    return A.two_delays(raw(spark, folder))


@query("a12_delay_correlation", over("raw", f"SELECT {real(f'corr({_DELAY}, {_DEV})', 'correlation')} FROM raw"))
def _(spark, folder):
    return A.delay_correlation(raw(spark, folder))


@query(
    "a13_by_status",
    over(
        "raw",
        f"""SELECT coalesce({_STATUS}, '<MISSING>') AS status, {whole('count(*)', 'rows')},
        min({_DELAY}) AS departure_delay_min, {real(f'quantile_cont({_DELAY}, 0.5)', 'departure_delay_median')},
        max({_DELAY}) AS departure_delay_max, min({_DEV}) AS performance_deviation_min,
        {real(f'quantile_cont({_DEV}, 0.5)', 'performance_deviation_median')},
        max({_DEV}) AS performance_deviation_max FROM raw GROUP BY 1""",
    ), text=("departure_delay_min", "departure_delay_max", "performance_deviation_min", "performance_deviation_max",))
def _(spark, folder):
    return A.by_status(raw(spark, folder))


@query(
    "a14_missing_masks",
    over(
        "faulty",
        f"""SELECT {whole(f'count(*) FILTER (WHERE {_STATUS} IS DISTINCT FROM ({band(_DEV)}))', 'threshold_rule_mismatches')},
        bool_and(({_STATUS} IS NULL) = ({_DEV} IS NULL)) AS missing_masks_equal FROM faulty""",
    ),
)
def _(spark, folder):
    from lagline.sources.lineitem import faulty_events

    return A.band_mismatches(faulty_events(raw(spark, folder)))


@query(
    "a15_sign_by_status",
    over(
        "raw",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS measure, coalesce({_STATUS}, '<MISSING>') AS status, CAST(sign({c}) AS INTEGER) AS sign,
            {whole('count(*)', 'rows')} FROM raw GROUP BY 2, 3"""
            for c in A.DELAYS
        ),
    ), text=("sign",))
def _(spark, folder):
    return A.sign_by_status(raw(spark, folder))


@query(
    "a16_stop_mapping",
    over(
        "raw",
        f"""SELECT {whole('(SELECT count(*) FROM p)', 'distinct_pairs')},
        {whole('(SELECT count(*) FROM (SELECT stop_id FROM p GROUP BY 1 HAVING count(*) > 1))', 'ids_with_multiple_names')},
        {whole('(SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY stop_id))', 'maximum_names_for_one_id')},
        {whole('(SELECT count(*) FROM (SELECT stop_name FROM p GROUP BY 1 HAVING count(*) > 1))', 'names_with_multiple_ids')},
        {whole('(SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY stop_name))', 'maximum_ids_for_one_name')}""",
        "p AS (SELECT DISTINCT stop_id, stop_name FROM raw WHERE stop_id IS NOT NULL AND stop_name IS NOT NULL)",
    ),
)
def _(spark, folder):
    return A.mapping_profile(raw(spark, folder))


@query("u3_distinct_pairs", over("raw", "SELECT DISTINCT stop_id, stop_name FROM raw WHERE stop_id IS NOT NULL AND stop_name IS NOT NULL"))
def _(spark, folder):
    return A.distinct_pairs(raw(spark, folder), "stop_id", "stop_name")


@query(
    "a17_date_coverage",
    over(
        "raw",
        f"""SELECT min(service_date) AS minimum, max(service_date) AS maximum, {whole('count(*)', 'distinct_dates')},
        {whole("date_diff('day', min(service_date), max(service_date)) + 1 - count(*)", 'missing_dates')},
        {whole('min(n)', 'minimum_rows_on_one_date')}, {whole('max(n)', 'maximum_rows_on_one_date')}
        FROM (SELECT service_date, count(*) AS n FROM raw GROUP BY 1)""",
    ), text=("minimum", "maximum",))
def _(spark, folder):
    return A.date_coverage(raw(spark, folder))


@query(
    "j6_missing_dates",
    over(
        "raw",
        """SELECT s.stop_id, s.day FROM spine s WHERE NOT EXISTS
        (SELECT 1 FROM seen e WHERE e.stop_id = s.stop_id AND e.day = s.day)""",
        "seen AS (SELECT DISTINCT stop_id, service_date AS day FROM raw)",
        """spine AS (SELECT stop_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT stop_id, CAST(min(day) AS TIMESTAMP) AS a, CAST(max(day) AS TIMESTAMP) AS b FROM seen GROUP BY stop_id))""",
    ),
    text=("day",),
)
def _(spark, folder):
    return A.missing_dates(raw(spark, folder), "service_date", ["stop_id"])


@query(
    "u2_unseen_hours",
    over(
        "clean",
        "SELECT CAST(i AS INTEGER) AS scheduled_hour FROM range(24) t(i) EXCEPT SELECT CAST(hour(scheduled_event_time) AS INTEGER) FROM clean",
    ),
)
def _(spark, folder):
    hours = spark.range(24).select(F.col("id").cast("int").alias("scheduled_hour"))
    # Some 24 values meet, not all events.
    return hours.subtract(clean(spark, folder).select(F.hour("scheduled_event_time").alias("scheduled_hour")).distinct())


@query(
    "a18_duplicates",
    over(
        "raw",
        f"""SELECT {whole('coalesce(sum(n - 1), 0)', 'additional_duplicate_rows')},
        {whole('coalesce(sum(n) FILTER (WHERE n > 1), 0)', 'rows_in_duplicate_groups')}
        FROM (SELECT count(*) AS n FROM raw GROUP BY {', '.join(S.RAW_COLUMNS)})""",
    ),
)
def _(spark, folder):
    return A.duplicates(raw(spark, folder))


@query(
    "a18b_duplicates_of_three",
    over(
        "raw",
        f"""SELECT {whole('coalesce(sum(n - 1), 0)', 'additional_duplicate_rows')},
        {whole('coalesce(sum(n) FILTER (WHERE n > 1), 0)', 'rows_in_duplicate_groups')}
        FROM (SELECT count(*) AS n FROM raw GROUP BY service_date, stop_id, direction_code)""",
    ),
)
def _(spark, folder):
    return A.duplicates(raw(spark, folder), ["service_date", "stop_id", "direction_code"])


_SCI = "regexp_full_match(trip_id, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)[Ee][+-]?[0-9]+')"


@query(
    "a19_scientific_share",
    over(
        "raw",
        f"""SELECT {whole('count(*)', 'non_missing')}, {whole(f'count(*) FILTER (WHERE {_SCI})', 'scientific_notation_count')},
        {real(f'100.0 * count(*) FILTER (WHERE {_SCI}) / count(*)', 'scientific_notation_percent')}
        FROM raw WHERE trip_id IS NOT NULL""",
    ),
)
def _(spark, folder):
    return A.scientific_ids(raw(spark, folder))


_CONTEXT = [*S.PROVENANCE, "service_date", "route_name", "stop_id", "stop_name", _STATUS]


@query(
    "w1_extremes_per_measure",
    over(
        "raw",
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT {', '.join(_CONTEXT)}, {c} AS value, '{c}' AS measure, '{label}' AS extreme_type FROM raw
            WHERE {c} IS NOT NULL ORDER BY {c} {way}, source_archive, source_file, source_row_number LIMIT 5)"""
            for c in A.DELAYS
            for label, way in (("smallest", "ASC"), ("largest", "DESC"))
        ),
    ), text=("service_date",))
def _(spark, folder):
    parts = [
        M.extremes(raw(spark, folder), c, 5, _CONTEXT).withColumnRenamed(c, "value").withColumn("measure", F.lit(c))
        for c in A.DELAYS
    ]
    return parts[0].unionByName(parts[1])
