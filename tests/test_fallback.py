"""Historical medians: isolation from the future, fallback, brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagline.operators import fallback as B

COLUMNS = (
    "event_key string, service_date date, route_name string, stop_id string, weekday int, day_type int, "
    "scheduled_minute_of_service_day int, departure_delay_seconds bigint"
)
HALF_HOUR = B.Config("small", minutes=30, minimum=2)


def frame(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", dt.date.fromisoformat(d), r, s, w, max(w - 4, 0), m, y) for i, (d, r, s, w, m, y) in enumerate(rows)],
        COLUMNS,
    )


UNIT = [
    ("2026-01-01", "1", "A", 0, 1500, 10),
    ("2026-01-01", "1", "A", 0, 1500, 20),
    ("2026-01-01", "1", "A", 0, 1500, 30),
    ("2026-01-30", "1", "A", 0, 1500, 10000),
    ("2026-02-01", "1", "A", 0, 1500, 20000),
]
FEBRUARY = [dt.date(2026, 2, 1)]


def answers(spark, history, asked):
    model = B.fit(history, [(HALF_HOUR, FEBRUARY)])
    rows = frame(spark, asked)
    predicted = B.predict(B.ask(rows, [HALF_HOUR], F.lit(FEBRUARY[0])), model)
    return {r["event_key"]: (r["estimate"], r["support"], r["depth"]) for r in predicted.collect()}


def test_embargoed_and_later_outcomes_do_not_matter(spark):
    before = B.fit(frame(spark, UNIT), [(HALF_HOUR, FEBRUARY)])
    changed = [(d, r, s, w, m, y * 7 if d >= "2026-01-30" else y) for d, r, s, w, m, y in UNIT]
    after = B.fit(frame(spark, changed), [(HALF_HOUR, FEBRUARY)])
    assert before.where("depth = 4").first()["median"] == 20.0
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0


def test_unknown_keys_and_service_hours(spark):
    got = answers(
        spark,
        frame(spark, UNIT),
        [
            ("2026-02-01", "9", "Z", 0, 1500, 0),  # nothing known: the global median
            ("2026-02-01", "1", "A", 0, 1500, 0),  # after midnight: its own slot
            ("2026-02-01", "1", "A", 0, 60, 0),  # same clock hour, other service hour
            ("2026-02-01", "1", "Z", 0, 60, 0),  # route only
        ],
    )
    assert got["e0"] == (20.0, 0, 4)
    assert got["e1"] == (20.0, 3, 0)
    assert got["e2"] == (20.0, 3, 2)
    assert got["e3"] == (20.0, 3, 3)


def test_no_history_gives_no_estimate(spark):
    got = answers(spark, frame(spark, UNIT[3:]), [("2026-02-01", "1", "A", 0, 1500, 0)])
    assert got["e0"] == (None, None, None)


@pytest.fixture(scope="module")
def random_events(spark):
    rng = np.random.default_rng(7)
    n = 6000
    days = pd.date_range("2026-01-01", "2026-03-31")
    data = pd.DataFrame(
        {
            "service_date": days[rng.integers(0, len(days), n)].date,
            # one route holds most rows; some keys are missing
            "route_name": rng.choice(["1", "1", "1", "4", None], n),
            "stop_id": rng.choice(["A", "A", "B", None], n),
            "scheduled_minute_of_service_day": rng.choice([300, 315, 1450, 2000], n).astype("int32"),
            "departure_delay_seconds": rng.integers(-200, 600, n),
        }
    )
    data["event_key"] = [f"e{i}" for i in range(n)]
    data["weekday"] = pd.to_datetime(data.service_date).dt.dayofweek.astype("int32")
    data["day_type"] = (data.weekday - 4).clip(lower=0).astype("int32")
    names = [c.strip().split()[0] for c in COLUMNS.split(",")]
    return data[names], spark.createDataFrame(data[names], COLUMNS)


def brute(data, config, cutoff, embargo, null_groups):
    """Direct per-row lookup in pandas."""
    end = cutoff - dt.timedelta(days=embargo)
    past = data[data.service_date < end]
    if config.days:
        past = past[past.service_date >= end - dt.timedelta(days=config.days)]

    def keyed(rows):
        out = rows.copy()
        out["slot"] = out.scheduled_minute_of_service_day // config.minutes
        out["day_key"] = out[config.day]
        return out.fillna({"route_name": "?", "stop_id": "?"}) if null_groups else out

    past, now = keyed(past), keyed(data[data.service_date >= cutoff])
    expected = {}
    levels = []
    for keys in (["route_name", "stop_id", "day_key", "slot"], ["route_name", "stop_id", "slot"], ["route_name", "stop_id"], ["route_name"]):
        g = past.groupby(keys).departure_delay_seconds.agg(["median", "size"])
        levels.append((keys, g[g["size"] >= config.minimum].to_dict("index")))
    overall = past.departure_delay_seconds.median()
    for row in now.to_dict("records"):
        expected[row["event_key"]] = (overall, 0, 4)
        for depth, (keys, table) in enumerate(levels):
            key = tuple(row[k] for k in keys)
            hit = table.get(key if len(key) > 1 else key[0])
            if hit:
                expected[row["event_key"]] = (hit["median"], hit["size"], depth)
                break
    return expected


@pytest.mark.parametrize("null_groups", [False, True])
@pytest.mark.parametrize("days", [0, 28])
def test_lookup_equals_brute_force(random_events, days, null_groups):
    data, events = random_events
    cutoff = dt.date(2026, 3, 1)
    config = B.Config("c", minutes=30, minimum=12, days=days, day="day_type")
    model = B.fit(events, [(config, [cutoff, dt.date(2026, 3, 15)])])
    asked = B.ask(events.where(F.col("service_date") >= F.lit(cutoff)), [config], F.lit(cutoff))
    predicted = B.predict(asked, model, keep_null_keys=null_groups)
    got = {r["event_key"]: (r["estimate"], r["support"], r["depth"]) for r in predicted.collect()}
    assert got == brute(data, config, cutoff, 2, null_groups)


def test_many_windows_use_several_passes(random_events):
    _, events = random_events
    cutoffs = [dt.date(2026, 2, 1) + dt.timedelta(days=d) for d in range(21)]
    config = B.Config("c", minutes=60, minimum=1)
    together = B.fit(events, [(config, cutoffs)])
    alone = B.fit(events, [(config, [cutoffs[-1]])])
    last = together.where(F.col("hist_end") == F.lit(cutoffs[-1] - dt.timedelta(days=2)))
    assert together.where("depth = 4").count() == len(cutoffs)
    assert last.exceptAll(alone).count() == 0 and alone.exceptAll(last).count() == 0


def test_every_cutoff_ignores_what_comes_after(random_events):
    _, events = random_events
    weeks = B.week_cutoffs(["2026-02-01", "2026-03-01"])
    config = B.Config("c", minutes=60, minimum=3)
    model = B.fit(events, [(config, weeks)])
    poisoned = events.withColumn(
        "departure_delay_seconds",
        F.when(F.col("service_date") >= F.lit(dt.date(2026, 2, 27)), 99999).otherwise(F.col("departure_delay_seconds")),
    )
    same = F.col("hist_end") <= F.lit(dt.date(2026, 2, 27))
    a, b = model.where(same), B.fit(poisoned, [(config, weeks)]).where(same)
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_wide_and_long_agree(random_events):
    _, events = random_events
    cutoff = F.lit(dt.date(2026, 3, 1))
    rows = events.where(F.col("service_date") >= cutoff)
    configs = [B.Config("x", 60, 5), B.Config("y", 15, 3, 56)]
    model = B.fit(events, [(c, [dt.date(2026, 3, 1)]) for c in configs])
    wide = B.predict_wide(rows, model, configs, cutoff)
    long = B.predict(B.ask(rows, configs, cutoff), model)
    for c in configs:
        a = long.where(F.col("candidate") == c.name).select("event_key", "estimate", "depth")
        b = wide.select("event_key", F.col(f"est_{c.name}"), F.col(f"depth_{c.name}"))
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_depth_usage_shows_unused_levels(spark):
    rows = spark.createDataFrame([("v", 0), ("v", 0), ("v", 2)], "phase string, depth int")
    got = {r["depth"]: r["records"] for r in B.depth_usage(rows, ["phase"]).collect()}
    assert got == {0: 2, 1: 0, 2: 1, 3: 0, 4: 0}


def test_batches_of_counts_change_nothing(spark, monkeypatch):
    """Keys cut by a batch's end, widths that divide none of the others, and windows without a day."""
    rows = [
        (dt.date(2026, 1, 1) + dt.timedelta(days=i % 50), ["1", "4", None][i % 3], ["A", None][i % 2], i % 7, max(0, i % 7 - 4), (i * 37) % 300, (i * 53) % 97)
        for i in range(2000)
    ]
    schema = "service_date date, route_name string, stop_id string, weekday int, day_type int, scheduled_minute_of_service_day int, departure_delay_seconds long"
    events = spark.createDataFrame(rows, schema).repartition(3)
    configs = [B.Config("a", 45, 1), B.Config("b", 60, 1), B.Config("c", 90, 1, days=14), B.Config("d", 45, 1, day="day_type"), B.Config("e", 7, 1, days=1)]
    cutoffs = [dt.date(2026, 1, 10), dt.date(2026, 2, 1), dt.date(2025, 12, 1)]
    found = B.fit(events, [(c, cutoffs) for c in configs])
    usual = sorted(map(str, found.collect()))
    monkeypatch.setattr(B, "COUNTS_AT_ONCE", 5)
    assert sorted(map(str, B.fit(events, [(c, cutoffs) for c in configs]).collect())) == usual
    plain = {}
    for day, route, stop, weekday, kind, minute, value in rows:
        for c in configs:
            for w in B.windows_for(c, cutoffs, B.S.EMBARGO_DAYS):
                if day < w.hist_end and (w.start is None or day >= w.start):
                    key = (c.day, c.minutes, w.hist_days, w.hist_end, route, stop, kind if c.day == "day_type" else weekday, minute // c.minutes)
                    plain.setdefault(key, []).append(value)
    names = ["day_kind", "minutes", "hist_days", "hist_end", "route_name", "stop_id", "day_key", "slot"]
    got = {tuple(r[n] for n in names): (r["median"], r["n"]) for r in found.where("depth = 0").collect()}
    assert got == {k: (float(np.median(v)), len(v)) for k, v in plain.items()}


def test_counts_are_kept_per_planned_slot(spark, monkeypatch):
    """One row per slot and delay, not per minute, and the same medians beside finer slots."""
    made = {}
    write = B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, label, *a: made.setdefault(label, []).append(write(df, label, *a)) or made[label][-1])
    rows = [("2026-01-01", r, "A", 3, m, 10 + m // 60) for r in ("1", None) for m in range(60, 180)]
    history = frame(spark, rows)
    hour, minute = B.Config("hour", minutes=60, minimum=1), B.Config("minute", minutes=1, minimum=1)
    alone = B.fit(history, [(hour, FEBRUARY)])
    assert made["delay-counts"][0].count() == 4  # 240 before
    both = B.fit(history, [(hour, FEBRUARY), (minute, FEBRUARY)])
    assert made["delay-counts"][1].count() == 240 and made["slot-counts"][0].count() == 4
    found = both.where("minutes IS NULL OR minutes = 60")
    assert alone.exceptAll(found).count() == 0 and found.exceptAll(alone).count() == 0
    fine = {(r.route_name, r.slot): (r["median"], r.n) for r in both.where("depth = 0 AND minutes = 1").collect()}
    assert fine == {(r, m): (10 + m // 60, 1) for _, r, _, _, m, _ in rows}


def test_cycles_meet_the_events_once(spark, monkeypatch):
    from lagline.plans import audit as P, backtest as T

    fits, fit = [], B.fit
    monkeypatch.setattr(B, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    rows = [(f"2026-0{m}-0{d}", "1", s, 0, 600 + d, 10 * m + d) for m in (1, 2, 3, 4) for d in (1, 3, 8) for s in ("A", None)]
    history = frame(spark, rows)
    months = ["2026-03-01", "2026-04-01"]
    found = T.audit_detail(history.withColumn("direction_code", F.lit("x")), B.BY_NAME["schedule_slot"], "week", months)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # two before
    before = lambda day: np.median([y for d, *_, y in rows if d < day])
    for r in found.collect():
        month, day = r.month.isoformat(), r.service_date.isoformat()
        base = before((r.month - dt.timedelta(days=2)).isoformat())
        week = dt.date.fromisoformat(month) + dt.timedelta(days=7 * (day[-2:] == "08"))
        assert (r.baseline_prediction, r.prediction) == (base, before((week - dt.timedelta(days=2)).isoformat())), r
    assert len(fits) == 1
    control = P.weekly_control(history, months).collect()
    assert len(fits) == 2 and [*sorted(r.month.isoformat() for r in control)] == months  # two fits for it before
