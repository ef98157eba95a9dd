"""Quantiles, samples, contracts, parsing, audits, requests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.functions.quantiles import bucket_quantiles
from lagline.operators import audit as A
from lagline.operators import contracts as Q
from lagline.operators import events as E
from lagline.operators import profile as P
from lagline.operators import summaries as M
from lagline.operators.sampling import sample_rows
from lagline.plans import scoring


@pytest.mark.parametrize("width", [1 / 64, 50.0])
def test_bucket_quantiles_equal_numpy(spark, width):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": rng.choice(["a", "a", "a", "b"], 3000), "v": rng.normal(0, 40, 3000)})
    data.loc[:900, "v"] = 12.25  # one value holds a third of the rows
    levels = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = bucket_quantiles(spark.createDataFrame(data), ["k"], "v", levels, width).collect()
    assert len(got) == 12
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile(data.v[data.k == r["k"]], r["level"]), abs=1e-9)
    whole = bucket_quantiles(spark.createDataFrame(data), [], "v", [0.5], width).first()
    assert whole["quantile"] == pytest.approx(np.quantile(data.v, 0.5), abs=1e-9)


@pytest.mark.parametrize("n", [1, 777, 5000, 9000])
def test_sample_is_the_first_n_draws(spark, n):
    import hashlib

    keys = [f"k{i}" for i in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys], "event_key string")
    got = {r[0] for r in sample_rows(df, "event_key", n, 42).collect()}
    want = sorted(keys, key=lambda k: hashlib.md5(f"{k}-42".encode()).hexdigest())[:n]
    assert got == set(want)


@pytest.mark.parametrize(
    "seconds, label",
    [(-180, "Very Early"), (-179, "Early"), (-60, "Early"), (-59, "On Time"), (180, "On Time"), (181, "Late"), (360, "Late"), (361, "Very Late"), (None, None)],
)
def test_status_bands(spark, seconds, label):
    df = spark.createDataFrame([(seconds,)], "d bigint")
    assert df.select(C.status_band(F.col("d"))).first()[0] == label


def test_clean_events_break_no_rule(raw):
    counts = Q.enforce(raw, Q.event_rules())
    assert counts["rows"] == 6000 and sum(counts.values()) == 6000


FAULTS = {
    "outer_whitespace": {"stop_name": "concat(stop_name, ' ')"},
    "control_whitespace": {"stop_name": "concat(stop_name, '\\t', 'x')"},
    "one_scheduled_time": {"scheduled_arrival_time": "scheduled_event", "scheduled_departure_time": "scheduled_event"},
    "deviation_and_status_missing_together": {"on_time_performance_status": "CAST(NULL AS STRING)"},
    "deviation_and_actual_missing_together": {"on_time_performance_deviation_seconds": "CAST(NULL AS BIGINT)"},
    "status_matches_deviation": {"on_time_performance_status": "'Very Early'"},
    "deviation_matches_times": {"on_time_performance_deviation_seconds": "on_time_performance_deviation_seconds + 1"},
    "service_day_or_next": {"service_date": "date_sub(service_date, 2)"},
}


@pytest.mark.parametrize("rule", FAULTS)
def test_each_fault_is_refused(raw, rule):
    one = raw.where("scheduled_departure_time IS NOT NULL AND on_time_performance_status = 'On Time'").limit(1)
    bad = one.withColumn("scheduled_event", F.col("scheduled_departure_time")).withColumns(
        {c: F.expr(e) for c, e in FAULTS[rule].items()}
    )
    with pytest.raises(Q.ContractError) as error:
        Q.enforce(bad, Q.event_rules())
    assert rule in error.value.violations
    assert error.value.samples


def test_no_rows_is_refused(raw):
    with pytest.raises(Q.ContractError):
        Q.enforce(raw.where("false"), Q.event_rules())


def test_schema_guards(raw):
    with pytest.raises(Q.ContractError):
        Q.require_exact_columns(raw.select(*reversed(raw.columns)), S.PROVENANCE + S.RAW_COLUMNS)
    with pytest.raises(Q.ContractError):
        Q.require_columns(raw.drop("stop_id"), ["stop_id"])
    with pytest.raises(Q.ContractError):
        Q.require_same_schema([raw, raw.withColumn("stop_sequence", F.col("stop_sequence").cast("int"))])
    Q.require_same_schema([raw, raw])


@pytest.mark.parametrize(
    "text, value",
    [("12", 12), ("12.0", 12), ("1e3", 1000), (" 7 ", 7), ("-3", -3), ("12.5", None), ("soon", None), ("9007199254740993", 9007199254740993)],
)
def test_parse_integer(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_integer(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(
    "text, value",
    [
        ("2026-01-05T06:30:00.000Z", dt.datetime(2026, 1, 5, 6, 30)),
        ("2026-01-05T06:30:00.123456789Z", dt.datetime(2026, 1, 5, 6, 30, 0, 123456)),
        ("2026-01-05T06:30:00Z", None),
        ("2026-01-05 06:30:00.0Z", None),
        ("2026-13-05T06:30:00.0Z", None),
    ],
)
def test_parse_timestamp(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_timestamp(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("text, value", [("1/5/2026", dt.date(2026, 1, 5)), ("01/05/2026", dt.date(2026, 1, 5)), ("13/01/2026", None), ("2026-01-05", None)])
def test_parse_date(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_date(F.col("t"))).first()[0] == value


def test_actual_time_follows_the_event_type(spark, raw):
    clean = E.derive(raw)
    hidden = clean.where("event_type = 'departure' AND actual_departure_time IS NULL AND actual_arrival_time IS NOT NULL")
    assert hidden.count() > 0
    assert hidden.where("actual_event_time IS NOT NULL").count() == 0


def test_features_hold_no_outcome(raw):
    clean = E.derive(raw)
    for table, target in ((E.regression_features(clean), S.TARGET), (E.classification_features(clean), S.CLASS_TARGET)):
        assert table.columns == ["event_key", *S.CONTEXT, *S.PREDICTORS, target]
        assert not set(S.PREDICTORS) & set(S.NEVER_PREDICTORS)
        assert table.count() == table.select("event_key").distinct().count()


def test_natural_order(spark):
    codes = spark.createDataFrame([(c,) for c in ["X1", "10", "9", "A", "70"]], "route_name string")
    assert [r[0] for r in codes.orderBy(*C.natural_order(F.col("route_name"))).collect()] == ["9", "10", "70", "A", "X1"]


def test_weeks_start_on_the_first(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2026-02-01', DATE'2026-03-31')) AS d")
    starts = {r[0] for r in days.select(C.week_start(F.col("d"))).collect()}
    from lagline.operators.fallback import week_cutoffs

    assert starts == set(week_cutoffs(["2026-02-01", "2026-03-01"]))


def test_profile_of_hand_made_rows(spark):
    df = spark.createDataFrame(
        [("a", "f", 1, "x", None), ("a", "f", 2, None, None), ("a", "f", 3, "y", None), ("a", "f", 4, "x", None), ("a", "f", 5, "w", None)],
        "source_archive string, source_file string, source_row_number bigint, c string, d string",
    )
    rows = {r["column"]: r for r in P.column_profile(df, ["c", "d"]).collect()}
    assert (rows["c"]["missing"], rows["c"]["unique_non_missing"], rows["c"]["most_common_value"]) == (1, 3, "x")
    assert rows["c"]["examples"] == "x | y | w"
    assert (rows["d"]["non_missing"], rows["d"]["most_common_value"], rows["d"]["examples"]) == (0, None, "")


def test_histogram_counts_every_visible_row(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    bins = M.histogram(df, "v", 0.0, 1.0, 10).orderBy("bin").collect()
    assert [b["records"] for b in bins] == [10] * 9 + [11]


def test_gate_readings_differ(spark):
    gains = spark.createDataFrame(
        [(dt.date(2026, 3, 1), 90.0, 100.0), (dt.date(2026, 4, 1), 290.0, 300.0), (dt.date(2026, 5, 1), 97.0, 100.0)],
        "month date, mae double, baseline_mae double",
    ).withColumn("gain_percent", (1 - F.col("mae") / F.col("baseline_mae")) * 100)
    got = A.gate(gains).first()
    assert got["search_gate_passed"] and not got["audit_gate_passed"]


def test_request_guards(spark):
    history = spark.createDataFrame([(dt.date(2026, 6, 30),)], "service_date date")
    asked = spark.createDataFrame(
        [
            ("ok", dt.date(2026, 7, 14), 0, 1),
            ("early", dt.date(2026, 5, 31), 10, 1),
            ("minute", dt.date(2026, 6, 2), 2880, 1),
            ("sequence", dt.date(2026, 6, 2), 10, 0),
            ("stale", dt.date(2026, 7, 15), 10, 1),
        ],
        "event_key string, service_date date, scheduled_minute_of_service_day int, stop_sequence bigint",
    )
    got = {r["event_key"]: r["rejected"] for r in scoring.judge(asked, history).collect()}
    assert got["ok"] is None and all(got[k] for k in ("early", "minute", "sequence", "stale"))
