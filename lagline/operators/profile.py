"""Structural and quality profile of an ingested table."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.functions.quantiles import value_counts, weighted_percentile
from lagline.sources.work import materialize

BROADCAST_MARKS = 1_000_000  # 16 bytes each

FEW_VALUES = 25
EXAMPLES = 3
HEAD = 1000  # rows that a pass for the examples brings to the driver
DELAYS = ["delay_on_departure_seconds", "on_time_performance_deviation_seconds"]


def top_values(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, missing included, most frequent first."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(S.MISSING)).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    ordered = counts.orderBy(F.desc("rows"), "value")
    return ordered.limit(top) if top else ordered


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) counts of all columns from one scan."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return value_counts(df.select(F.inline(cells)), ["column"], "value")


def first_values(df: DataFrame, columns: Sequence[str], top: int = EXAMPLES) -> DataFrame:
    """The first distinct values of each column by provenance, joined as text.

    Every pass takes the first ``HEAD`` rows that have a value not found yet in a column that still
    lacks some, so its rows hold each such column's next values. What ``top`` passes don't find
    comes from aggregates without keys: the earliest new value of each column, one row per task.
    Rows of one place count by value; where a pass ends amid a place, that place is left to the next.
    """
    place = F.struct(*[F.col(c) for c in S.PROVENANCE])
    found: dict[str, list[str]] = {c: [] for c in columns}

    def new(c: str) -> Column:
        value = F.col(c).cast("string")
        return value.isNotNull() & ~value.isin(found[c]) if found[c] else value.isNotNull()

    left = list(columns)
    for _ in range(top):
        values = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(left)]
        taken = df.where(functools.reduce(Column.__or__, map(new, left))).select(place.alias("place"), *values)
        head = taken.orderBy(*[f"place.{c}" for c in S.PROVENANCE]).limit(HEAD).collect()
        ended = len(head) < HEAD
        for _, rows in itertools.groupby(head if ended else [r for r in head if r[0] != head[-1][0]], key=lambda r: r[0]):
            for c, cells in zip(left, list(zip(*rows))[1:]):
                for value in sorted({v for v in cells if v is not None} - set(found[c])):
                    found[c] = [*found[c], value][:top]
        left = [] if ended else [c for c in left if len(found[c]) < top]
        if not left:
            break
    while left:
        earliest = [
            F.min(F.when(new(c), F.struct(place.alias("place"), F.col(c).cast("string").alias("value"))))["value"].alias(f"v{i}")
            for i, c in enumerate(left)
        ]
        nexts = dict(zip(left, df.agg(*earliest).first()))
        for c, value in nexts.items():
            if value is not None:
                found[c].append(value)
        left = [c for c in left if nexts[c] is not None and len(found[c]) < top]
    rows = [(c, " | ".join(values)) for c, values in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, examples string")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing, distinct, most common value, three examples by first appearance.

    Cells meet as counts per (column, value), spread over both, so neither a constant nor a
    unique column gathers in one task.
    """
    cells = unpivoted(df, columns)
    present = F.col("value").isNotNull()
    # The most frequent value; a tie goes to the smallest, with missing first.
    commonest = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    totals = cells.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_missing"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("unique_non_missing"),
        commonest.alias("common"),
    )
    rows = F.col("non_missing") + F.col("missing")
    return totals.join(first_values(df, columns), "column", "left").select(
        "column",
        "non_missing",
        "missing",
        (100.0 * F.col("missing") / rows).alias("missing_percent"),
        "unique_non_missing",
        F.col("common.value").alias("most_common_value"),
        F.col("common.n").alias("most_common_count"),
        (100.0 * F.col("common.n") / rows).alias("most_common_percent"),
        "examples",
    )


def small_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of the columns with few distinct values."""
    cells = unpivoted(df, columns)
    few = cells.groupBy("column").agg(F.count("value").alias("distinct")).where(F.col("distinct") <= FEW_VALUES)
    return cells.join(few.select("column"), "column", "left_semi").select(
        "column", F.coalesce("value", F.lit(S.MISSING)).alias("value"), F.col("n").alias("rows")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] = tuple(DELAYS)) -> DataFrame:
    """Range, mean, quantiles and rows outside the interquartile fences, per measure."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    counts = value_counts(
        df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where(F.col("value").isNotNull()),
        ["column"],
        "value",
    )
    n, v = F.col("n"), F.col("value")
    stats = counts.groupBy("column").agg(
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        weighted_percentile("value", S.PROFILE_LEVELS).alias("q"),
    )
    q1, q3 = F.col("q")[S.PROFILE_LEVELS.index(0.25)], F.col("q")[S.PROFILE_LEVELS.index(0.75)]
    fenced = stats.withColumn("iqr_lower_fence", q1 - 1.5 * (q3 - q1)).withColumn(
        "iqr_upper_fence", q3 + 1.5 * (q3 - q1)
    )
    names = [f"q{str(p).replace('.', '_')}" for p in S.PROFILE_LEVELS]
    # one row per measure on this side
    outside = counts.join(
        F.broadcast(fenced.select("column", "iqr_lower_fence", "iqr_upper_fence")), "column"
    ).groupBy("column").agg(
        F.sum(F.when(v < F.col("iqr_lower_fence"), n).otherwise(0)).alias("below_iqr_fence"),
        F.sum(F.when(v > F.col("iqr_upper_fence"), n).otherwise(0)).alias("above_iqr_fence"),
    )
    return fenced.join(outside, "column").select(
        "column",
        "minimum",
        "maximum",
        "mean",
        *[F.col("q")[i].alias(a) for i, a in enumerate(names)],
        "iqr_lower_fence",
        "iqr_upper_fence",
        "below_iqr_fence",
        "above_iqr_fence",
    )


def _clock_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("ts")) for c in columns])
    return df.select("service_date", F.explode(cells).alias("c")).select("service_date", "c.column", "c.ts")


def timestamp_profile(df: DataFrame, columns: Sequence[str] = tuple(S.TIMESTAMPS)) -> DataFrame:
    return _clock_cells(df, columns).groupBy("column").agg(
        F.min("ts").alias("minimum"),
        F.max("ts").alias("maximum"),
        F.count_if(F.hour("ts").between(0, 4)).alias("midnight_to_04_59_count"),
    )


def timestamp_offsets(df: DataFrame, columns: Sequence[str] = tuple(S.TIMESTAMPS)) -> DataFrame:
    """Days between the clock's date and the service date; a missing clock has a null offset."""
    return (
        _clock_cells(df, columns)
        .groupBy("column", C.day_offset(F.col("ts"), F.col("service_date")).alias("day_offset"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _presence(a: str, b: str, prefix: str) -> list[Column]:
    x, y = F.col(a).isNotNull(), F.col(b).isNotNull()
    cases = {"arrival_only": x & ~y, "departure_only": ~x & y, "both": x & y, "neither": ~x & ~y}
    return [F.count_if(flag).alias(f"{prefix}_{name}") for name, flag in cases.items()]


def presence(df: DataFrame) -> DataFrame:
    return df.agg(
        *_presence("scheduled_arrival_time", "scheduled_departure_time", "scheduled"),
        *_presence("actual_arrival_time", "actual_departure_time", "actual"),
    )


def _difference_quantiles(value: str, prefix: str) -> list[Column]:
    q = weighted_percentile(value, S.DIFFERENCE_LEVELS)
    return [q[i].alias(f"{prefix}_q{str(p).replace('.', '_')}") for i, p in enumerate(S.DIFFERENCE_LEVELS)]


def computed_deviation(df: DataFrame) -> DataFrame:
    """Clock difference against the reported deviation, departures and arrivals apart."""
    reported = F.col("on_time_performance_deviation_seconds")

    def gap(kind: str) -> Column:
        return F.abs(
            C.seconds_between(F.col(f"actual_{kind}_time"), F.col(f"scheduled_{kind}_time")) - reported
        ).cast("double")

    def both(kind: str) -> Column:
        return F.col(f"scheduled_{kind}_time").isNotNull() & F.col(f"actual_{kind}_time").isNotNull()

    rows = df.select(
        both("departure").alias("d"), both("arrival").alias("a"), gap("departure").alias("dg"), gap("arrival").alias("ag")
    )
    counts = value_counts(rows, ["d", "a"], "dg", "ag")
    n = F.col("n")

    def total(flag: Column) -> Column:
        return F.sum(F.when(flag, n).otherwise(0))

    return counts.agg(
        total(F.col("d")).alias("departure_pairs"),
        total(F.col("d") & (F.col("dg") == 0)).alias("departure_equal"),
        total(F.col("d") & (F.col("dg") <= 1)).alias("departure_within_one_second"),
        *_difference_quantiles("dg", "departure_gap"),
        total(F.col("a")).alias("arrival_pairs"),
        total(F.col("a") & (F.col("ag") == 0)).alias("arrival_equal"),
        F.max("ag").alias("arrival_gap_maximum"),
    )


def two_delays(df: DataFrame) -> DataFrame:
    """How far the two delay measures agree on rows that have both."""
    a, b = DELAYS
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.abs(F.col(a) - F.col(b)).alias("gap"))
    n = F.col("n")
    return value_counts(rows, [], "gap").agg(
        F.sum(n).alias("rows_with_both"),
        F.sum(F.when(F.col("gap") == 0, n).otherwise(0)).alias("equal"),
        *_difference_quantiles("gap", "gap"),
    )


def delay_correlation(df: DataFrame) -> DataFrame:
    a, b = DELAYS
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("correlation"))


def delay_missing_despite_departure(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(
            F.col("delay_on_departure_seconds").isNull() & F.col("actual_departure_time").isNotNull()
        ).alias("rows")
    )


def by_status(df: DataFrame) -> DataFrame:
    """Range and median of both measures per label, the missing label included."""
    a, b = DELAYS
    counts = value_counts(df, ["on_time_performance_status"], a, b)

    def facts(column: str, name: str) -> list[Column]:
        return [
            F.min(column).alias(f"{name}_min"),
            weighted_percentile(column, 0.5).alias(f"{name}_median"),
            F.max(column).alias(f"{name}_max"),
        ]

    return counts.groupBy(F.coalesce("on_time_performance_status", F.lit(S.MISSING)).alias("status")).agg(
        F.sum("n").alias("rows"), *facts(a, "departure_delay"), *facts(b, "performance_deviation")
    )


def band_mismatches(df: DataFrame) -> DataFrame:
    """Rows off the band rule, and whether label and deviation are missing on the same rows."""
    deviation, status = F.col("on_time_performance_deviation_seconds"), F.col("on_time_performance_status")
    return df.agg(
        F.count_if(~status.eqNullSafe(C.status_band(deviation))).alias("threshold_rule_mismatches"),
        F.bool_and(status.isNull() == deviation.isNull()).alias("missing_masks_equal"),
    )


def sign_by_status(df: DataFrame) -> DataFrame:
    """Label x sign of each measure; missing on either side is its own cell."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("measure"), F.signum(F.col(c).cast("double")).cast("int").alias("sign"))
        for c in DELAYS
    ])
    return (
        df.select(
            F.coalesce("on_time_performance_status", F.lit(S.MISSING)).alias("status"), F.inline(cells)
        )
        .groupBy("measure", "status", "sign")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).dropna().dropDuplicates()


def mapping_profile(df: DataFrame, a: str = "stop_id", b: str = "stop_name") -> DataFrame:
    """Is a -> b a function, and b -> a?"""
    pairs = distinct_pairs(df, a, b)
    # both directions are counted from the same distinct pairs in one pass
    sides = pairs.select(
        F.inline(F.array(
            F.struct(F.lit("a").alias("side"), F.col(a).alias("key")),
            F.struct(F.lit("b").alias("side"), F.col(b).alias("key")),
        ))
    ).groupBy("side", "key").agg(F.count(F.lit(1)).alias("partners"))
    of_a, of_b = F.col("side") == "a", F.col("side") == "b"
    return sides.agg(
        F.sum(F.when(of_a, F.col("partners"))).alias("distinct_pairs"),
        F.count_if(of_a & (F.col("partners") > 1)).alias("ids_with_multiple_names"),
        F.max(F.when(of_a, F.col("partners"))).alias("maximum_names_for_one_id"),
        F.count_if(of_b & (F.col("partners") > 1)).alias("names_with_multiple_ids"),
        F.max(F.when(of_b, F.col("partners"))).alias("maximum_ids_for_one_name"),
    )


def daily_counts(df: DataFrame, day: str = "service_date") -> DataFrame:
    return df.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def date_coverage(df: DataFrame, day: str = "service_date") -> DataFrame:
    counts = daily_counts(df, day)
    days = F.count(F.lit(1))
    return counts.where(F.col("day").isNotNull()).agg(
        F.min("day").alias("minimum"),
        F.max("day").alias("maximum"),
        days.alias("distinct_dates"),
        (F.datediff(F.max("day"), F.min("day")) + 1 - days).alias("missing_dates"),
        F.min("rows").alias("minimum_rows_on_one_date"),
        F.max("rows").alias("maximum_rows_on_one_date"),
    )


def missing_dates(df: DataFrame, day: str = "service_date", keys: Sequence[str] = ()) -> DataFrame:
    """Days between the first and last one on which nothing was recorded, per key if any."""
    seen = df.select(*keys, F.col(day).alias("day")).where(F.col("day").isNotNull()).distinct()
    spine = seen.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        *keys, F.explode(F.sequence("a", "b")).alias("day")
    )
    return spine.join(seen, [*keys, "day"], "left_anti")


def row_marks(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row; equal rows have equal marks, unequal ones hardly ever."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    # Grouping takes -0.0 for 0.0; hashes skip nulls, so which fields are null is hashed too.
    values = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if c in floating else F.col(c) for c in columns]
    empty = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(empty, *values), F.xxhash64(F.lit(7), *reversed(values), empty)]


def duplicates(df: DataFrame, columns: Sequence[str] = tuple(S.RAW_COLUMNS), marks=row_marks) -> DataFrame:
    """Rows repeated over the supplied columns; null equals null.

    Two hashes per row are counted first, and only rows whose hashes occur more than once are
    compared by their columns: unique rows travel as 24 bytes, whatever their width, and equal
    hashes of unequal rows change nothing.
    """
    first, second = marks(df, columns)
    hashed = df.select(first.alias("__h1"), second.alias("__h2"), *columns)
    counts = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"))
    repeated = materialize(counts.where("__n > 1").select("__h1", "__h2"), "repeated-rows")
    # Measured before it is sent to every executor; beyond that the join shuffles.
    if repeated.count() <= BROADCAST_MARKS:
        repeated = F.broadcast(repeated)
    groups = (
        hashed.join(repeated, ["__h1", "__h2"], "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("additional_duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
    )


def scientific_ids(df: DataFrame, column: str = "trip_id") -> DataFrame:
    known = df.where(F.col(column).isNotNull())
    flag = C.is_scientific(F.col(column))
    return known.agg(
        F.count(F.lit(1)).alias("non_missing"),
        F.count_if(flag).alias("scientific_notation_count"),
        (100.0 * F.count_if(flag) / F.count(F.lit(1))).alias("scientific_notation_percent"),
    )
