"""Grouped distribution summaries of the deviation from schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.functions.quantiles import value_counts, weighted_percentile

DEVIATION = "on_time_performance_deviation_seconds"
STATUS = "on_time_performance_status"
WHOLE = "decimal(38,0)"


def measured(clean: DataFrame) -> DataFrame:
    return clean.where("has_performance_measurement")


def whole_sum(value: Column) -> Column:
    """A sum of whole numbers without rounding, up to 38 digits."""
    return F.sum(value.cast(WHOLE)).cast(WHOLE)


def spread_about_mean(rows: Column, s1: Column, s2: Column) -> Column:
    """Sum of squared distances from the mean of whole numbers, from their count and power sums.

    The sums are moved to the whole part of the mean in exact decimals before anything is
    rounded, so a large common offset cancels without loss.
    """
    count = rows.cast(WHOLE)
    # A remainder is exact where a quotient is not.
    rest = F.pmod(s1, count).cast(WHOLE)
    centre = ((s1 - rest).cast(WHOLE) / count).cast(WHOLE)
    about = (s2 - (centre * (centre * count + rest * 2).cast(WHOLE)).cast(WHOLE)).cast("double")
    return about - rest.cast("double") * rest.cast("double") / rows


def _moments() -> list[Column]:
    """Summary columns over (deviation, status, n) rows of one group; deviations are whole seconds."""
    x, n = F.col(DEVIATION).cast("decimal(19,0)"), F.col("n")
    rows, s1, s2 = F.sum(n), whole_sum(x * n), whole_sum(x * x * n)
    p = weighted_percentile(DEVIATION, [0.5, 0.9, 0.95])

    def share(flag: Column) -> Column:
        return 100.0 * F.sum(F.when(flag, n).otherwise(0)) / rows

    return [
        rows.alias("records"),
        (s1.cast("double") / rows).alias("mean_deviation_seconds"),
        p[0].alias("median_deviation_seconds"),
        F.when(rows > 1, F.sqrt(F.greatest(spread_about_mean(rows, s1, s2), F.lit(0.0)) / (rows - 1))).alias(
            "std_deviation_seconds"
        ),
        p[1].alias("p90_deviation_seconds"),
        p[2].alias("p95_deviation_seconds"),
        share(C.is_early(F.col(STATUS))).alias("early_percent"),
        share(C.is_on_time(F.col(STATUS))).alias("on_time_percent"),
        share(C.is_late(F.col(STATUS))).alias("late_percent"),
    ]


def summarize(events: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Size, moments, exact quantiles and punctuality shares; a null key is its own group."""
    return value_counts(events, groups, DEVIATION, STATUS).groupBy(*groups).agg(*_moments())


# The summary tables: name -> key columns.
FAMILY = {
    "route": ["route_name"],
    "hour": ["scheduled_hour"],
    "weekday": ["weekday_number", "weekday", "period_group"],
    "period": ["period_group"],
    "month": ["month_number", "month"],
    "event_type": ["event_type"],
    "stop": ["stop_id", "stop_name"],
}


def summarize_family(events: DataFrame) -> DataFrame:
    """All summary tables from one scan, in long form.

    The counting step carries every table's grouping at once, so the wide input is read once
    and what is shuffled are counts per (table, key, value).
    """
    keys = list(dict.fromkeys(k for ks in FAMILY.values() for k in ks))
    label = F.lit(None).cast("string")
    # grouping_id() has one bit per key, the first key leftmost, set where the key is absent.
    for name, wanted in FAMILY.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in wanted)
        label = F.when(F.col("__set") == bits, F.lit(name)).otherwise(label)
    sets = [[F.col(k) for k in ks] + [F.col(DEVIATION), F.col(STATUS)] for ks in FAMILY.values()]
    counts = (
        events.groupingSets(sets, *[F.col(k) for k in keys], F.col(DEVIATION), F.col(STATUS))
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__gid"))
        .withColumn("__set", F.shiftright("__gid", 2))
        .withColumn("table", label)
    )
    first = {name: ks[0] for name, ks in FAMILY.items()}
    key = F.lit(None).cast("string")
    detail = F.lit(None).cast("string")
    for name, ks in FAMILY.items():
        key = F.when(F.col("table") == name, F.col(first[name]).cast("string")).otherwise(key)
        if len(ks) > 1:
            detail = F.when(F.col("table") == name, F.col(ks[1]).cast("string")).otherwise(detail)
    return (
        counts.withColumn("key", key)
        .withColumn("detail", detail)
        .groupBy("table", "key", "detail")
        .agg(*_moments())
    )


def by_route(events: DataFrame) -> DataFrame:
    return summarize(events, FAMILY["route"]).orderBy(*C.natural_order(F.col("route_name")))


def by_stop(events: DataFrame) -> DataFrame:
    return summarize(events, FAMILY["stop"]).orderBy(F.desc("records"), "stop_id")


def overall(clean: DataFrame) -> DataFrame:
    """Eleven measures over two populations (all events, measured events) in one pass."""
    counts = value_counts(
        clean,
        ["has_performance_measurement", "has_departure_delay", "is_after_midnight_service"],
        DEVIATION,
        STATUS,
    )
    n, has = F.col("n"), F.col("has_performance_measurement")
    x = F.col(DEVIATION).cast("double")
    rows = F.sum(F.when(has, n).otherwise(0))
    p = weighted_percentile(DEVIATION, [0.5, 0.9, 0.95])

    def share(flag: Column) -> Column:
        return 100.0 * F.sum(F.when(has & flag, n).otherwise(0)) / rows

    return counts.agg(
        F.sum("n").alias("total_clean_records"),
        rows.alias("performance_records"),
        F.sum(F.when(F.col("has_departure_delay"), n).otherwise(0)).alias("departure_delay_records"),
        F.sum(F.when(F.col("is_after_midnight_service"), n).otherwise(0)).alias("after_midnight_records"),
        (F.sum(x * n) / rows).alias("mean_deviation_seconds"),
        p[0].alias("median_deviation_seconds"),
        p[1].alias("p90_deviation_seconds"),
        p[2].alias("p95_deviation_seconds"),
        share(C.is_early(F.col(STATUS))).alias("early_percent"),
        share(C.is_on_time(F.col(STATUS))).alias("on_time_percent"),
        share(C.is_late(F.col(STATUS))).alias("late_percent"),
    )


def status_distribution(events: DataFrame) -> DataFrame:
    """Every label in its fixed order, seen or not, with its share of measured events."""
    spark = events.sparkSession
    labels = spark.createDataFrame(
        [(i, s) for i, s in enumerate(S.STATUSES)], "position int, status string"
    )
    counts = events.groupBy(F.col(STATUS).alias("status")).agg(F.count(F.lit(1)).alias("records"))
    whole = Window.partitionBy()  # five rows, after aggregation
    return (
        F.broadcast(labels)
        .join(counts, "status", "left")
        .withColumn("percent", 100.0 * F.col("records") / F.sum("records").over(whole))
        .orderBy("position")
    )


def dense_hours(hourly: DataFrame) -> DataFrame:
    """All 24 hours; an hour without events has count 0 and no measures."""
    spine = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("scheduled_hour"))
    return (
        spine.join(hourly, "scheduled_hour", "left")
        .withColumn("records", F.coalesce("records", F.lit(0)))
        .orderBy("scheduled_hour")
    )


def highest(summary: DataFrame, measure: str, top: int, at_least: int, tie: str) -> DataFrame:
    """Top rows by a measure among groups of sufficient size."""
    return summary.where(F.col("records") >= at_least).orderBy(F.desc(measure), tie).limit(top)


def lowest(summary: DataFrame, measure: str, top: int, at_least: int, tie: str) -> DataFrame:
    return summary.where(F.col("records") >= at_least).orderBy(F.asc(measure), tie).limit(top)


def extremes(df: DataFrame, measure: str, top: int, context: Sequence[str], labels=("smallest", "largest")) -> DataFrame:
    """Smallest and largest rows of a measure, ties by provenance; each is a bounded top-k."""
    known = df.where(F.col(measure).isNotNull())
    order = [F.col(c) for c in S.PROVENANCE]
    low = known.orderBy(F.asc(measure), *order).limit(top).select(*context, measure)
    high = known.orderBy(F.desc(measure), *order).limit(top).select(*context, measure)
    return low.withColumn("extreme_type", F.lit(labels[0])).unionByName(
        high.withColumn("extreme_type", F.lit(labels[1]))
    )


def histogram(df: DataFrame, value: str, low_level: float, high_level: float, bins: int) -> DataFrame:
    """Equal-width bins over a quantile range of a whole/half-second measure.

    Limits and bins come from the same value counts: the rows are read once.
    """
    counts = value_counts(df.where(F.col(value).isNotNull()), [], value)
    limits = counts.agg(weighted_percentile(value, [low_level, high_level]).alias("p"))
    return _binned(counts, limits, value, bins)


def error_histogram(df: DataFrame, value: str, high_level: float, bins: int) -> DataFrame:
    """Bins from the smallest value up to a quantile."""
    counts = value_counts(df.where(F.col(value).isNotNull()), [], value)
    limits = counts.agg(
        F.array(F.min(value).cast("double"), weighted_percentile(value, high_level)).alias("p")
    )
    return _binned(counts, limits, value, bins)


def _binned(counts: DataFrame, limits: DataFrame, value: str, bins: int) -> DataFrame:
    # The visible range decides the edges, as a plot of the visible rows does.
    edges = limits.select(F.struct(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")).alias("e"))
    visible = counts.withColumn("e", edges.scalar()).where(
        F.col(value).between(F.col("e.lo"), F.col("e.hi"))
    )
    span = visible.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("s")
    )
    placed = visible.withColumn("s", span.scalar()).withColumn(
        "bin",
        # the top edge belongs to the last bin
        F.least(
            F.width_bucket(F.col(value).cast("double"), F.col("s.lo"), F.col("s.hi"), F.lit(bins)), F.lit(bins)
        ).cast("int"),
    )
    return placed.groupBy("bin").agg(
        F.sum("n").alias("records"),
        F.max(F.col("s.lo") + (F.col("bin") - 1) * (F.col("s.hi") - F.col("s.lo")) / bins).alias("lower_edge"),
        F.max(F.col("s.lo") + F.col("bin") * (F.col("s.hi") - F.col("s.lo")) / bins).alias("upper_edge"),
    )


def density(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts on a square grid."""
    return df.groupBy(
        F.floor(F.col(x) / width).cast("bigint").alias("x_cell"),
        F.floor(F.col(y) / width).cast("bigint").alias("y_cell"),
    ).agg(F.count(F.lit(1)).alias("records"))
