"""Data contracts: every rule of a set is counted in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.operators.profile import BROADCAST_MARKS, row_marks
from lagline.sources.work import materialize


class ContractError(ValueError):
    """Raised with the violated rules and their counts."""

    def __init__(self, violations: Mapping[str, int], samples: Sequence[dict] = ()):
        self.violations, self.samples = dict(violations), list(samples)
        super().__init__(f"contract violated: {self.violations}; first rows: {self.samples}")


def _col(name: str) -> Column:
    return F.col(name)


def _any(flags: Sequence[Column]) -> Column:
    result = F.lit(False)
    for flag in flags:
        result = result | F.coalesce(flag, F.lit(False))
    return result


def text_rules(columns: Sequence[str] = tuple(S.TEXTS)) -> dict[str, Column]:
    return {
        "outer_whitespace": _any([C.has_outer_space(_col(c)) for c in columns]),
        "control_whitespace": _any([C.has_control_space(_col(c)) for c in columns]),
    }


def event_rules() -> dict[str, Column]:
    """What a typed event must satisfy before it may be cleaned."""
    arrival, departure = _col("scheduled_arrival_time"), _col("scheduled_departure_time")
    scheduled = C.by_event_type(departure, departure, arrival)
    actual = C.by_event_type(departure, _col("actual_departure_time"), _col("actual_arrival_time"))
    deviation = _col("on_time_performance_deviation_seconds")
    status = _col("on_time_performance_status")
    offset = C.day_offset(scheduled, _col("service_date"))
    return {
        **text_rules(),
        "one_scheduled_time": arrival.isNull() == departure.isNull(),
        "deviation_and_status_missing_together": deviation.isNull() != status.isNull(),
        "deviation_and_actual_missing_together": deviation.isNull() != actual.isNull(),
        "status_matches_deviation": ~status.eqNullSafe(C.status_band(deviation)),
        # with an actual time, a missing deviation is a mismatch as well
        "deviation_matches_times": actual.isNotNull()
        & ~C.seconds_between(actual, scheduled).eqNullSafe(deviation.cast("decimal(18,6)")),
        "service_day_or_next": ~F.coalesce(offset.isin(0, 1), F.lit(False)),
    }


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations), zero counts included; one aggregate with partial counts."""
    counts = df.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def sample_violations(df: DataFrame, rules: Mapping[str, Column], top: int = 5) -> DataFrame:
    """The first offending rows per rule and source file.

    Ranks are cut inside every partition before rows move, so a rule that nearly every row
    breaks still sends only a handful of rows per task.
    """
    broken = F.filter(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]),
        lambda r: r.isNotNull(),
    )
    rows = df.select(*S.PROVENANCE, F.explode(broken).alias("rule"))
    order = Window.partitionBy("rule", "source_archive", "source_file").orderBy("source_row_number")
    return (
        rows.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top)
        .groupBy("rule", "source_archive", "source_file")
        .agg(F.array_sort(F.collect_list("source_row_number")).alias("rows"))
    )


def enforce(df: DataFrame, rules: Mapping[str, Column], allow_empty: bool = False) -> dict[str, int]:
    """Run the rules; raise if any row breaks one or if there is no row at all."""
    flags = [F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *flags).first().asDict()
    rows = counts.pop("__rows")
    broken = {name: n for name, n in counts.items() if n}
    if broken:
        sampled = sample_violations(df, {n: rules[n] for n in broken})
        shown = sampled.orderBy(*(c for c, kind in sampled.dtypes if not kind.startswith("map"))).limit(20)
        raise ContractError(broken, [r.asDict() for r in shown.collect()])
    if not rows and not allow_empty:
        raise ContractError({"no_rows": 1})
    return {"rows": rows, **counts}


# ---- parsing -----------------------------------------------------------------------------


def parsers() -> dict[str, Column]:
    """Typed value of each raw text column."""
    parsed = {"service_date": C.parse_date(C.na_to_null(_col("service_date")))}
    parsed |= {c: C.parse_timestamp(C.na_to_null(_col(c))) for c in S.TIMESTAMPS}
    parsed |= {c: C.parse_integer(C.na_to_null(_col(c))) for c in S.INTEGERS}
    return parsed


def parse_rules() -> dict[str, Column]:
    """A value that is present and cannot be read breaks the rule of its column."""
    return {c: C.na_to_null(_col(c)).isNotNull() & typed.isNull() for c, typed in parsers().items()}


def typed_events(text: DataFrame) -> DataFrame:
    parsed = parsers()
    return text.select(
        *S.PROVENANCE, *[parsed.get(c, C.na_to_null(_col(c))).alias(c) for c in S.RAW_COLUMNS]
    )


# ---- columns and labels -------------------------------------------------------------------


def require_exact_columns(df: DataFrame, expected: Sequence[str]) -> None:
    if df.columns != list(expected):
        raise ContractError({"columns": 1}, [{"expected": list(expected), "found": df.columns}])


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError({"missing_columns": len(missing)}, [{"missing": missing}])


def require_same_schema(frames: Sequence[DataFrame]) -> None:
    """Names and types must agree; nullability may differ."""
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for frame in frames[1:]:
        if [(f.name, f.dataType) for f in frame.schema] != first:
            raise ContractError({"schema_changed": 1}, [{"expected": first, "found": frame.dtypes}])


def unexpected_statuses(df: DataFrame, status: str = "on_time_performance_status") -> DataFrame:
    return (
        df.where(F.col(status).isNotNull() & ~F.col(status).isin(S.STATUSES))
        .groupBy(F.col(status).alias("status"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def split_rules(target: str = S.TARGET) -> dict[str, Column]:
    return {"missing_target": _col(target).isNull()}


# ---- counters -----------------------------------------------------------------------------


def cleaning_counters(clean: DataFrame) -> DataFrame:
    return clean.agg(
        F.count_if(_col("event_type") == "arrival").alias("arrival_events"),
        F.count_if(_col("event_type") == "departure").alias("departure_events"),
        F.count_if("is_after_midnight_service").alias("after_midnight_events"),
        F.count_if("has_performance_measurement").alias("performance_measurements_available"),
        F.count_if("has_departure_delay").alias("departure_delays_available"),
        F.count_if(_col("direction_code").isNull()).alias("rows_with_missing_direction"),
        F.count_if(
            _col("actual_departure_time").isNotNull() & _col("delay_on_departure_seconds").isNull()
        ).alias("rows_with_actual_departure_but_missing_departure_delay"),
    )


def feature_counters(features: DataFrame, target: str, classes: bool = False) -> DataFrame:
    """Long form (counter, rows): totals, per split, per class."""
    split = F.concat(F.lit("split_"), F.col("data_split"))
    label = F.concat(F.lit("class_"), F.col(target)) if classes else F.lit(None).cast("string")
    tags = F.filter(
        F.array(
            F.lit("rows"),
            split,
            F.when(F.col("direction_code").isNull(), "missing_direction"),
            F.when(F.col(target).isNull(), "missing_target"),
            label,
        ),
        lambda t: t.isNotNull(),
    )
    return features.select(F.explode(tags).alias("counter")).groupBy("counter").agg(
        F.count(F.lit(1)).alias("rows")
    )


def changed_rows(before: DataFrame, after: DataFrame, columns: Sequence[str], marks=row_marks) -> DataFrame:
    """Rows present on one side only, counted as a multiset; zero when nothing was altered.

    Rows meet by two 64-bit hashes, 24 bytes each whatever their width. Those whose hashes occur
    unequally often on the two sides are compared by their columns.
    """
    left = before.select(*columns, F.lit(1).alias("__side"))
    right = after.select(*columns, F.lit(-1).alias("__side"))
    both = left.unionByName(right)
    first, second = marks(both, columns)
    hashed = both.select(first.alias("__h1"), second.alias("__h2"), "__side", *columns)
    balances = hashed.groupBy("__h1", "__h2").agg(F.sum("__side").alias("balance"))
    unequal = materialize(balances.where("balance <> 0").select("__h1", "__h2"), "unequal-rows")
    # Measured before it is sent to every executor; beyond that the join shuffles.
    if unequal.count() <= BROADCAST_MARKS:
        unequal = F.broadcast(unequal)
    return (
        hashed.join(unequal, ["__h1", "__h2"], "left_semi")
        .groupBy(*columns)
        .agg(F.sum("__side").alias("balance"))
        .agg(F.coalesce(F.sum(F.abs("balance")), F.lit(0)).alias("rows_changed"))
    )
