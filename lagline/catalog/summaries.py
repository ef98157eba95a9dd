"""Grouped summaries, top lists, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog.prelude import over, real, whole
from lagline.catalog.registry import clean, query
from lagline.functions import columns as C
from lagline.operators import events as E
from lagline.operators import summaries as M

_DEV = M.DEVIATION
_MEASURES = ",\n".join([
    whole("count(*)", "records"),
    real(f"avg({_DEV})", "mean_deviation_seconds"),
    real(f"quantile_cont({_DEV}, 0.5)", "median_deviation_seconds"),
    real(f"stddev_samp({_DEV})", "std_deviation_seconds"),
    real(f"quantile_cont({_DEV}, 0.9)", "p90_deviation_seconds"),
    real(f"quantile_cont({_DEV}, 0.95)", "p95_deviation_seconds"),
    real("100.0 * avg(CAST(is_early AS INTEGER))", "early_percent"),
    real("100.0 * avg(CAST(is_on_time AS INTEGER))", "on_time_percent"),
    real("100.0 * avg(CAST(is_late AS INTEGER))", "late_percent"),
])


def measured(spark, folder):
    return E.with_calendar(M.measured(clean(spark, folder)))


def _grouped(keys: list[str], tail: str = "") -> str:
    ks = ", ".join(keys)
    return over("cal", f"SELECT {ks}, {_MEASURES} FROM cal GROUP BY {ks} {tail}")


@query("a1a_route_summary", _grouped(["route_name"]))
def route_summary(spark, folder):
    return M.by_route(measured(spark, folder))


def _family_query(name, table):
    def build(spark, folder):
        return M.summarize(measured(spark, folder), M.FAMILY[table]).orderBy(*M.FAMILY[table])

    query(name, _grouped(M.FAMILY[table]))(build)


_family_query("a1b_hourly_summary", "hour")
_family_query("a1c_weekday_summary", "weekday")
_family_query("a1d_period_summary", "period")
_family_query("a1e_monthly_summary", "month")
_family_query("a1f_event_type_summary", "event_type")


@query("a1g_stop_summary", _grouped(["stop_id", "stop_name"]))
def _(spark, folder):
    return M.by_stop(measured(spark, folder))


@query(
    "a1_summary_family",
    over(
        "cal",
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", CAST({ks[0]} AS VARCHAR) AS key, "
            + (f"CAST({ks[1]} AS VARCHAR)" if len(ks) > 1 else "CAST(NULL AS VARCHAR)")
            + f" AS detail, {_MEASURES} FROM cal GROUP BY {', '.join(ks)}"
            for name, ks in M.FAMILY.items()
        ),
    ),
)
def _(spark, folder):
    return M.summarize_family(measured(spark, folder))


@query(
    "a2_overall_summary",
    over(
        "cal",
        f"""SELECT {whole('(SELECT count(*) FROM clean)', 'total_clean_records')},
        {whole('count(*)', 'performance_records')},
        {whole('(SELECT count(delay_on_departure_seconds) FROM clean)', 'departure_delay_records')},
        {whole('(SELECT count(*) FROM clean WHERE is_after_midnight_service)', 'after_midnight_records')},
        {real(f'avg({_DEV})', 'mean_deviation_seconds')},
        {real(f'quantile_cont({_DEV}, 0.5)', 'median_deviation_seconds')},
        {real(f'quantile_cont({_DEV}, 0.9)', 'p90_deviation_seconds')},
        {real(f'quantile_cont({_DEV}, 0.95)', 'p95_deviation_seconds')},
        {real('100.0 * avg(CAST(is_early AS INTEGER))', 'early_percent')},
        {real('100.0 * avg(CAST(is_on_time AS INTEGER))', 'on_time_percent')},
        {real('100.0 * avg(CAST(is_late AS INTEGER))', 'late_percent')} FROM cal""",
    ),
)
def _(spark, folder):
    return M.overall(clean(spark, folder))


_STATUS_SQL = f"""SELECT s.position, s.status, c.records, {real('100.0 * c.records / sum(c.records) OVER ()', 'percent')}
FROM (VALUES (0, 'Very Early'), (1, 'Early'), (2, 'On Time'), (3, 'Late'), (4, 'Very Late')) s(position, status)
LEFT JOIN (SELECT on_time_performance_status AS status, {whole('count(*)', 'records')} FROM cal GROUP BY 1) c
ON s.status = c.status"""


@query("a3_status_distribution", over("cal", _STATUS_SQL), text=("records",))
def _(spark, folder):
    return M.status_distribution(measured(spark, folder))


@query("j8_label_spine", over("cal", f"SELECT status, records FROM ({_STATUS_SQL})"), text=("records",))
def _(spark, folder):
    return M.status_distribution(measured(spark, folder)).select("status", "records")


@query(
    "w7_share_of_total",
    over(
        "cal",
        f"""SELECT route_name, {whole('count(*)', 'records')},
        {real('100.0 * count(*) / sum(count(*)) OVER ()', 'percent')} FROM cal GROUP BY route_name""",
    ),
)
def _(spark, folder):
    counts = measured(spark, folder).groupBy("route_name").agg(F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records").alias("t"))
    return counts.withColumn("percent", 100.0 * F.col("records") / total.scalar())


@query(
    "j7_dense_hours",
    over(
        "cal",
        f"""SELECT CAST(h.i AS INTEGER) AS scheduled_hour, {whole('coalesce(s.records, 0)', 'records')},
        s.median_deviation_seconds, s.on_time_percent
        FROM range(24) h(i) LEFT JOIN (SELECT scheduled_hour, {_MEASURES} FROM cal GROUP BY scheduled_hour) s
        ON h.i = s.scheduled_hour""",
    ),
)
def _(spark, folder):
    hourly = M.summarize(measured(spark, folder), ["scheduled_hour"])
    return M.dense_hours(hourly).select(
        "scheduled_hour", "records", "median_deviation_seconds", "on_time_percent"
    )


_EXTREME = [
    "source_file", "source_row_number", "service_date", "route_name", "stop_id", "stop_name", "event_type",
    "on_time_performance_status",
]


@query(
    "w2_extreme_records",
    over(
        "cal",
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT {', '.join(_EXTREME)}, {_DEV}, '{label}' AS extreme_type FROM cal
            ORDER BY {_DEV} {way}, source_archive, source_file, source_row_number LIMIT 10)"""
            for label, way in (("most_early", "ASC"), ("most_late", "DESC"))
        ),
    ), text=("service_date",))
def _(spark, folder):
    return M.extremes(measured(spark, folder), _DEV, 10, _EXTREME, ("most_early", "most_late"))


@query(
    "w3_top_stops",
    over(
        "cal",
        f"""SELECT stop_id, stop_name, {whole('count(*)', 'records')},
        {real(f'quantile_cont({_DEV}, 0.5)', 'median_deviation_seconds')}, stop_name || ' [' || stop_id || ']' AS label
        FROM cal GROUP BY stop_id, stop_name HAVING count(*) >= 1000
        ORDER BY quantile_cont({_DEV}, 0.5) DESC, stop_id LIMIT 15""",
    ),
)
def _(spark, folder):
    stops = M.summarize(measured(spark, folder), ["stop_id", "stop_name"])
    top = M.highest(stops, "median_deviation_seconds", 15, 1000, "stop_id")
    return top.select(
        "stop_id", "stop_name", "records", "median_deviation_seconds",
        C.labelled(F.col("stop_name"), F.col("stop_id")).alias("label"),
    ).orderBy("median_deviation_seconds")


@query(
    "w4_top_and_bottom_routes",
    over(
        "cal",
        """SELECT * FROM (SELECT 'highest' AS side, * FROM big ORDER BY median_deviation_seconds DESC, route_name LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'lowest' AS side, * FROM big ORDER BY median_deviation_seconds, route_name LIMIT 5)""",
        f"""big AS (SELECT route_name, {whole('count(*)', 'records')},
        {real(f'quantile_cont({_DEV}, 0.5)', 'median_deviation_seconds')} FROM cal
        GROUP BY route_name HAVING count(*) >= 10000)""",
    ),
)
def _(spark, folder):
    routes = M.summarize(measured(spark, folder), ["route_name"]).select(
        "route_name", "records", "median_deviation_seconds"
    )
    high = M.highest(routes, "median_deviation_seconds", 5, 10_000, "route_name").withColumn("side", F.lit("highest"))
    low = M.lowest(routes, "median_deviation_seconds", 5, 10_000, "route_name").withColumn("side", F.lit("lowest"))
    return high.unionByName(low)


_EDGES = "s.lo + (b - 1) * (s.hi - s.lo) / {n} AS DOUBLE), 6) AS lower_edge, round(CAST(s.lo + b * (s.hi - s.lo) / {n}"


def histogram_sql(source: str, value: str, low: str, high: str, bins: int) -> list[str]:
    """Three table expressions and a select over them."""
    return [
        f"lim AS (SELECT {low} AS lo, {high} AS hi FROM {source} WHERE {value} IS NOT NULL)",
        f"vis AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source}, lim WHERE {value} BETWEEN lo AND hi)",
        "span AS (SELECT min(v) AS lo, max(v) AS hi FROM vis)",
        f"""binned AS (SELECT least(CAST(floor((v - s.lo) / (s.hi - s.lo) * {bins}) AS INTEGER) + 1, {bins}) AS b, s.lo, s.hi
        FROM vis, span s)""",
    ]


HISTOGRAM_SELECT = """SELECT b AS bin, CAST(count(*) AS BIGINT) AS records,
round(min(s.lo + (b - 1) * (s.hi - s.lo) / {n}), 6) AS lower_edge,
round(min(s.lo + b * (s.hi - s.lo) / {n}), 6) AS upper_edge FROM binned s GROUP BY b"""


@query(
    "a31_deviation_histogram",
    over(
        "clean",
        HISTOGRAM_SELECT.format(n=90),
        *histogram_sql("clean", _DEV, f"quantile_cont({_DEV}, 0.005)", f"quantile_cont({_DEV}, 0.995)", 90),
    ),
)
def _(spark, folder):
    return M.histogram(clean(spark, folder), _DEV, 0.005, 0.995, 90)
