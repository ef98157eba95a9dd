"""Hierarchical historical medians: fit on embargoed history, look up finest first.

Levels, finest first::

    0  route, stop, day key, time slot
    1  route, stop, time slot
    2  route, stop
    3  route
    4  everything

A fit serves many configurations and many cutoffs at once. Rows are read once and reduced to
counts per (route, stop, weekday, slot, history step, delay), where a *step* is the stretch of
days between two neighbouring window edges and the slot is the widest that divides all planned
ones. Everything else is a lattice of sums over these counts: a wide slot is the sum of the widest
planned slots that divide it, a day type the sum of its weekdays, a level the sum of the one below.
The finest slots go straight to their sorted passes; wider ones start from a written table of
counts per slot, whose rows are bounded by slots and delays rather than minutes. Each is placed once
by route, stop and a span of minutes that none of its slots crosses; all slots and day keys are
nested in it, so their sums and sorted passes need no further placing.

Counts are sorted by delay once per level and shape, and all of its cutoffs are answered in that
one pass, so nothing carries history x cutoffs or history x shapes rows. Slot width and day key
do not matter above level 1, so those levels are fitted once for all configurations. The fitted
levels are one written table, as a saved model is.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.sources.work import materialize

GLOBAL_DEPTH = 4
SHAPE_KEYS = {0: ["day_kind", "minutes"], 1: ["minutes"], 2: [], 3: [], 4: []}
GROUP_KEYS = {
    0: ["route_name", "stop_id", "day_key", "slot"],
    1: ["route_name", "stop_id", "slot"],
    2: ["route_name", "stop_id"],
    3: ["route_name"],
    4: [],
}
WINDOW_KEYS = ["hist_days", "hist_end"]
TABLE_COLUMNS = {
    "depth": "int",
    "day_kind": "string",
    "minutes": "int",
    "hist_days": "int",
    "hist_end": "date",
    "route_name": "string",
    "stop_id": "string",
    "day_key": "int",
    "slot": "int",
    "median": "double",
    "n": "bigint",
}
COUNTS_AT_ONCE = 1 << 17  # rows of counts that a task answers together
COUNTS_OF_TASK = 1 << 18  # rows of counts in a task, on average


@dataclass(frozen=True)
class Config:
    """One way to group history. ``days=0`` means all history."""

    name: str
    minutes: int
    minimum: int
    days: int = 0
    day: str = "weekday"


# ---- Fixed values: the candidate grid --------------------------------------------------
CANDIDATES = [
    Config("original_grouped", minutes=60, minimum=30),
    Config("half_hour", minutes=30, minimum=15),
    Config("quarter_hour", minutes=15, minimum=10),
    Config("schedule_slot", minutes=1, minimum=8),
    Config("recent_56d", minutes=30, minimum=10, days=56),
    Config("recent_28d", minutes=30, minimum=6, days=28),
    Config("recent_slot_56d", minutes=1, minimum=6, days=56),
    Config("day_type", minutes=30, minimum=15, day="day_type"),
]
BY_NAME = {c.name: c for c in CANDIDATES}


SETTINGS = "name string, minutes int, minimum int, days int, day string"
MONTH_PARTITION = "service_month"  # partition column of a stored feature table


def month_cutoffs(months: Iterable[str]) -> list[dt.date]:
    return [dt.date.fromisoformat(m) for m in months]


def week_cutoffs(months: Iterable[str]) -> list[dt.date]:
    """Refresh days: every seventh day from the first of each month."""
    days = []
    for first in month_cutoffs(months):
        after = (first + dt.timedelta(days=32)).replace(day=1)
        days += [first + dt.timedelta(days=d) for d in range(0, (after - first).days, 7)]
    return days


@dataclass(frozen=True)
class Window:
    hist_days: int
    hist_end: dt.date

    @property
    def start(self) -> dt.date | None:
        return self.hist_end - dt.timedelta(days=self.hist_days) if self.hist_days else None


def windows_for(config: Config, cutoffs: Iterable[dt.date], embargo: int) -> list[Window]:
    """History of each cutoff: ends strictly before cutoff - embargo, may be bounded below."""
    return [Window(config.days, c - dt.timedelta(days=embargo)) for c in cutoffs]


def _with_step(events: DataFrame, edges: list[dt.date]) -> DataFrame:
    """Number the stretch between window edges that each service date falls into.

    The list of days is indexed by position, so the cost per row does not grow with the
    number of edges.
    """
    first, last = edges[0], edges[-1]
    starts, steps, step = set(edges), [], 0
    for offset in range((last - first).days + 1):
        if first + dt.timedelta(days=offset) in starts:
            step += 1
        steps.append(step)
    listed = ",".join(map(str, steps))
    return events.withColumn(
        "step",
        F.expr(
            f"""CASE WHEN service_date < DATE'{first}' THEN 0 ELSE element_at(array({listed}),
            least(datediff(service_date, DATE'{first}') + 1, {len(steps)})) END"""
        ),
    )


def fit(
    events: DataFrame,
    plans: Sequence[tuple[Config, Sequence[dt.date]]],
    embargo: int = S.EMBARGO_DAYS,
) -> DataFrame:
    """Median and size of every group at every level, for every planned window.

    ``events`` has service_date, route_name, stop_id, weekday, day_type, the minute of the
    service day and the target. The result is one table keyed by (depth, day_kind, minutes,
    hist_days, hist_end, keys); keys a level does not use are null. No minimum size is
    applied here and no null key dropped: both belong to the lookup, because callers differ.
    """
    planned = [(c, w) for c, cutoffs in plans for w in windows_for(c, cutoffs, embargo)]
    windows = sorted({w for _, w in planned}, key=lambda w: (w.hist_days, w.hist_end))
    edges = sorted({w.hist_end for w in windows} | {w.start for w in windows if w.start})
    lower = None if any(w.start is None for w in windows) else min(w.start for w in windows)

    history = events.where(F.col("service_date") < F.lit(edges[-1]))
    if lower:
        history = history.where(F.col("service_date") >= F.lit(lower))
    if MONTH_PARTITION in events.columns:  # lets the scan leave out whole months
        history = history.where(F.col(MONTH_PARTITION) <= F.lit(edges[-1]))
        if lower:
            history = history.where(F.col(MONTH_PARTITION) >= F.lit(lower.replace(day=1)))
    # Step k holds the days from edges[k-1] up to edges[k]; step 0 everything earlier.
    reach = {
        w: [
            k
            for k in range(len(edges))
            if edges[k] <= w.hist_end and (w.start is None or k > 0 and edges[k - 1] >= w.start)
        ]
        for w in windows
    }
    shapes = sorted({(c.day, c.minutes) for c, _ in planned})
    widths = sorted({m for _, m in shapes})
    unit = math.gcd(*widths)
    rows = _with_step(history, edges).withColumn("value", F.col(S.TARGET)).where("value IS NOT NULL")
    rows = rows.withColumn("slot", F.expr(f"int(scheduled_minute_of_service_day div {unit})"))
    finest = ["route_name", "stop_id", "weekday", "day_type", "slot"]
    counts = materialize(rows.groupBy(*finest, "step", "value").agg(F.count(F.lit(1)).alias("n")), "delay-counts")
    # Wider slots have far fewer counts than the finest ones; all of them start from the widest that divides them.
    tiers = [(unit, [unit], counts)] if unit in widths else []
    if wider := [m for m in widths if m > unit]:
        base = math.gcd(*wider)
        if base > unit:
            counts = materialize(_summed(_widened(counts, base // unit), finest), "slot-counts")
        tiers.append((base, wider, counts))
    tables = []

    def add(frame: DataFrame, depth: int, keys: list[str], asked: Iterable[Window], **shape):
        """Medians of a level for the windows that are asked of it, in its place of the table."""
        asked = set(asked)
        table = _medians(frame, keys, [(w, reach[w]) for w in windows if w in asked])
        table = table.join(pairs, "pair") if "pair" in keys else table
        values = {c: f"{v!r}" for c, v in shape.items()} | {"depth": str(depth)}
        held = {*GROUP_KEYS[depth], *WINDOW_KEYS, "median", "n"}
        tables.append(
            table.selectExpr(*[
                c if c in held else f"CAST({values.get(c, 'NULL')} AS {t}) AS {c}" for c, t in TABLE_COLUMNS.items()
            ])
        )

    def asked_of(**shape) -> set[Window]:
        return {w for c, w in planned if all(getattr(c, k) == v for k, v in shape.items())}

    # Sorts compare numbers much faster than texts, so a number stands for route and stop meanwhile.
    pairs = counts.select("route_name", "stop_id").distinct().withColumn("pair", F.monotonically_increasing_id())
    pairs = materialize(pairs, "route-stops")
    place = ["pair", "span"]
    for base, held, found in tiers:
        span = math.lcm(*held) // base
        numbered = found.alias("e").join(pairs.alias("a"), _matching(["route_name", "stop_id"])).select(
            "a.pair", "e.weekday", "e.day_type", "e.slot", F.expr(f"int(e.slot div {span}) AS span"), "e.step", "e.value", "e.n"
        )
        placed = numbered.repartition(_tasks(found), *place)
        by_day, by_slot = {base: placed}, {base: placed}  # a sorted pass takes equal values in several rows
        for m in held:
            if m > base:
                finer = max(w for w in by_day if m % w == 0)
                by_day[m] = _summed(_widened(by_day[finer], m // finer), [*place, "weekday", "day_type", "slot"])
                by_slot[m] = _summed(_widened(by_slot[finer], m // finer), [*place, "slot"])
            for day in sorted({d for d, width in shapes if width == m}):
                keyed = by_day[m].withColumn("day_key", F.expr(f"int({day})"))
                add(keyed, 0, [*place, "day_key", "slot"], asked_of(day=day, minutes=m), day_kind=day, minutes=m)
            add(by_slot[m], 1, [*place, "slot"], asked_of(minutes=m), minutes=m)

    stops = materialize(_summed(counts, GROUP_KEYS[2]), "stop-counts")
    coarse = {2: stops, 3: _summed(stops, GROUP_KEYS[3])}
    coarse[4] = _summed(coarse[3], GROUP_KEYS[4])
    for depth, frame in coarse.items():
        keys = GROUP_KEYS[depth]
        add(frame.repartition(*keys) if keys else frame, depth, keys, windows)
    model = tables[0]
    for table in tables[1:]:
        model = model.unionByName(table)
    return materialize(model, "fallback-model", ["depth"])


def _tasks(counts: DataFrame) -> int:
    """Tasks that the counts are dealt to, by their number of rows.

    Given as a number, because adaptive execution would bring partitions together by their
    compressed bytes, and a task's sorts and its time go with its rows.
    """
    return max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // COUNTS_OF_TASK))


def _widened(counts: DataFrame, times: int) -> DataFrame:
    """Counts whose slots are ``times`` as wide, not yet summed."""
    return counts.withColumn("slot", F.expr(f"int(slot div {times})"))


def _summed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per coarser keys."""
    return counts.groupBy(*keys, "step", "value").agg(F.sum("n").alias("n"))


def _medians(counts: DataFrame, keys: list[str], windows: Sequence[tuple[Window, list[int]]]) -> DataFrame:
    """Median and size per key and history window from (keys, step, value, n) rows placed by the keys.

    Rows come sorted by key and value. A window's running count over that order crosses half of a
    key's total at its median, and one search per window finds the crossings of all keys at hand.
    A task holds some batches of counts and the key that is still open at their end.
    """
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    spans = [(w.hist_days, w.hist_end, steps[0], steps[-1]) for w, steps in windows if steps]
    out = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["hist_days int", "hist_end date", "median double", "n bigint"])

    def answered(table: pa.Table, begins: np.ndarray):
        step, value, n = (table.column(len(keys) + i).to_numpy() for i in range(3))
        last = np.r_[begins[1:], len(step)] - 1
        named = table.select(keys).take(pa.array(begins))
        for days, end, low, high in spans:
            upto = np.cumsum(np.where((step >= low) & (step <= high), n, 0))
            before = np.where(begins > 0, upto[begins - 1], 0)
            total = upto[last] - before
            held = np.flatnonzero(total)
            if len(held):
                before, total = before[held], total[held]
                middle = [value[np.searchsorted(upto, before + rank)] for rank in ((total + 1) // 2, total // 2 + 1)]
                size = len(held)
                columns = [c.combine_chunks() for c in named.take(pa.array(held)).columns]
                columns += [pa.array([days] * size, pa.int32()), pa.array([end] * size, pa.date32())]
                columns += [pa.array((middle[0] + middle[1]) / 2.0), pa.array(total.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "hist_days", "hist_end", "median", "n"])

    def begins_of(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            changed = np.zeros(table.num_rows - 1, bool)
            for k in keys:
                c = table.column(k)
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                changed |= pc.fill_null(pc.not_equal(a, b), False).to_numpy()
                changed |= pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy()
            new[1:] = changed
        return np.flatnonzero(new)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COUNTS_AT_ONCE:
                table = pa.Table.from_batches(held)
                begins = begins_of(table)
                open_at = int(begins[-1])
                if open_at:
                    yield from answered(table.slice(0, open_at), begins[:-1])
                held = table.slice(open_at).combine_chunks().to_batches()
                rows = 0  # of new ones: an open key is looked at again after as many more
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            yield from answered(table, begins_of(table))

    ordered = counts.select(*keys, "step", "value", "n")
    ordered = ordered.sortWithinPartitions(*keys, "value") if keys else ordered.coalesce(1).sortWithinPartitions("value")
    return ordered.mapInArrow(run, out)


def ask(
    events: DataFrame,
    configs: Sequence[Config],
    cutoff: Column,
    embargo: int = S.EMBARGO_DAYS,
) -> DataFrame:
    """Attach to each event what to look up: config, window and keys (one row per config)."""
    minute = "scheduled_minute_of_service_day"
    options = ",".join(
        f"('{c.name}', '{c.day}', {c.minutes}, bigint({c.minimum}), {c.days}, int({c.day}), int({minute} div {c.minutes}))"
        for c in configs
    )
    return events.withColumn("cutoff", cutoff).selectExpr(
        "*",
        f"date_sub(cutoff, {embargo}) AS hist_end",
        f"inline(array({options})) AS (candidate, day_kind, minutes, minimum, hist_days, day_key, slot)",
    )


QUESTION = ["day_kind", "minutes", "minimum", "hist_days", "hist_end", "route_name", "stop_id", "day_key", "slot"]


def _matching(keys: Sequence[str]) -> Column:
    """Join condition e = a over keys of which route and stop may be missing."""
    return F.expr(" AND ".join(
        f"e.{k} {'<=>' if k in ('route_name', 'stop_id') else '='} a.{k}" for k in keys
    ))


def answer(questions: DataFrame, model: DataFrame, keep_null_keys: bool = False) -> DataFrame:
    """Resolve distinct questions to (estimate, support, depth), finest level first.

    Coarse tables are small and adaptive execution broadcasts whichever measures small; the
    finest ones join by shuffle.
    """
    resolved = questions.alias("q")
    for depth in range(GLOBAL_DEPTH + 1):
        keys = SHAPE_KEYS[depth] + GROUP_KEYS[depth] + WINDOW_KEYS
        level = model.where(f"depth = {depth}").selectExpr(
            *[f"{k} AS k{depth}_{k}" for k in keys], f"median AS median{depth}", f"n AS n{depth}"
        )
        null_safe = GROUP_KEYS[depth] if keep_null_keys else []
        on = [f"q.{k} {'<=>' if k in null_safe else '='} k{depth}_{k}" for k in keys]
        if depth < GLOBAL_DEPTH:
            on.append(f"n{depth} >= q.minimum")
        resolved = resolved.join(level, F.expr(" AND ".join(on)), "left")
    found = [f"WHEN median{d} IS NOT NULL THEN" for d in range(GLOBAL_DEPTH + 1)]
    levels = range(GLOBAL_DEPTH)
    return resolved.selectExpr(
        *[f"q.{c} AS {c}" for c in questions.columns],
        f"coalesce({', '.join(f'median{d}' for d in range(GLOBAL_DEPTH + 1))}) AS estimate",
        # the global value is no evidence about this group
        f"CASE {' '.join(f'{found[d]} n{d}' for d in levels)} {found[GLOBAL_DEPTH]} bigint(0) END AS support",
        f"CASE {' '.join(f'{found[d]} {d}' for d in range(GLOBAL_DEPTH + 1))} END AS depth",
    )


def predict(asked: DataFrame, model: DataFrame, keep_null_keys: bool = False) -> DataFrame:
    """Estimate, support and depth for every asked event.

    The level lookups run on the distinct questions; the events themselves are joined once,
    on the full key, where adaptive execution can split a hot key.
    """
    questions = asked.select(*QUESTION).distinct()
    answers = answer(questions, model, keep_null_keys).alias("a")
    return asked.alias("e").join(answers, _matching(QUESTION), "left").select(
        "e.*", "a.estimate", "a.support", "a.depth"
    )


def predict_wide(
    events: DataFrame,
    model: DataFrame,
    configs: Sequence[Config],
    cutoff: Column,
    embargo: int = S.EMBARGO_DAYS,
    keep_null_keys: bool = False,
) -> DataFrame:
    """One row per event with ``est_/support_/depth_<config>`` columns."""
    named = {c.name: c for c in configs}
    return predict_cycles(events.withColumn("cutoff", cutoff), model, {"cutoff": named}, embargo, keep_null_keys)


def predict_cycles(
    events: DataFrame,
    model: DataFrame,
    cycles: Mapping[str, Mapping[str, Config]],
    embargo: int = S.EMBARGO_DAYS,
    keep_null_keys: bool = False,
) -> DataFrame:
    """One row per event with ``est_/support_/depth_<name>`` columns of several refresh cycles.

    ``cycles`` gives, per column that holds a cutoff, the configurations that are asked at it, by
    name. A question is (cutoffs, route, stop, weekday, minute): it settles the answer of every
    configuration and cycle, so all of them are resolved on the distinct questions and the events
    are joined once. The answers are written first: where they measure small the events stay where
    they are, else both are shuffled once.
    """
    minute = "scheduled_minute_of_service_day"
    keys = [*cycles, "route_name", "stop_id", "weekday", minute]
    options = ",".join(
        f"('{name}', '{c.day}', {c.minutes}, bigint({c.minimum}), {c.days}, date_sub({cutoff}, {embargo}), int({c.day}), "
        f"int({minute} div {c.minutes}))"
        for cutoff, named in cycles.items()
        for name, c in named.items()
    )
    asked = events.select(*keys, "day_type").distinct().selectExpr(
        "*", f"inline(array({options})) AS (candidate, day_kind, minutes, minimum, hist_days, hist_end, day_key, slot)"
    )
    answered = answer(asked, model, keep_null_keys)
    columns = [
        F.expr(f"max(CASE WHEN candidate = '{name}' THEN {value} END) AS {prefix}_{name}")
        for named in cycles.values()
        for name in named
        for value, prefix in (("estimate", "est"), ("support", "support"), ("depth", "depth"))
    ]
    wide = materialize(answered.groupBy(*keys).agg(*columns), "answers").alias("a")
    added = [f"a.{c}" for c in wide.columns if c not in keys]
    return events.alias("e").join(wide, _matching(keys), "left").select("e.*", *added)


def predict_long(
    events: DataFrame, model: DataFrame, configs: Sequence[Config], cutoff: Column, embargo: int = S.EMBARGO_DAYS
) -> DataFrame:
    """One row per event and configuration with its estimate, support and depth.

    The events are joined once, in the wide form; a row per configuration comes after that and
    goes no further than what reads it.
    """
    wide = predict_wide(events, model, configs, cutoff, embargo)
    options = ", ".join(
        f"named_struct('candidate', '{c.name}', 'estimate', est_{c.name}, 'support', support_{c.name}, 'depth', depth_{c.name})"
        for c in configs
    )
    return wide.selectExpr(*events.columns, "cutoff", f"inline(array({options}))")


def depth_usage(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and share per fallback level; a level nobody used shows with zero."""
    # ---- Fixed values: names of the levels
    names = [
        "route + stop + weekday + hour",
        "route + stop + hour",
        "route + stop",
        "route",
        "global median",
    ]
    counts = predicted.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("records"))
    per_group = counts.groupBy(*keys).agg(
        F.sum("records").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("depth", "records"))).alias("used"),
    )
    levels = F.array(*[
        F.struct(F.lit(i).alias("depth"), F.lit(name).alias("fallback_level")) for i, name in enumerate(names)
    ])
    return (
        per_group.where("total > 0")
        .withColumn("l", F.explode(levels))
        .select(
            *keys,
            F.col("l.depth").alias("depth"),
            F.col("l.fallback_level").alias("fallback_level"),
            F.coalesce(F.try_element_at("used", F.col("l.depth")), F.lit(0)).alias("records"),
            "total",
        )
        .withColumn("percent", 100.0 * F.col("records") / F.col("total"))
        .drop("total")
    )


def save(model: DataFrame, configs: Sequence[Config], path: str) -> None:
    """Level tables and, beside them, the settings of the configurations they serve."""
    spark = model.sparkSession
    model.write.mode("overwrite").parquet(f"{path}/levels")
    rows = [(c.name, c.minutes, c.minimum, c.days, c.day) for c in configs]
    spark.createDataFrame(rows, SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[Config]]:
    rows = spark.read.schema(SETTINGS).json(f"{path}/settings").orderBy("name").collect()
    return spark.read.parquet(f"{path}/levels"), [Config(**r.asDict()) for r in rows]
