"""SQL for the as-of fallback, written the direct way: one range join per cutoff list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from lagline.operators.fallback import Config

EMBARGO = 2


def cut_list(name: str, config: Config, cutoffs: Sequence[dt.date], embargo: int = EMBARGO) -> str:
    rows = []
    for c in cutoffs:
        end = c - dt.timedelta(days=embargo)
        start = end - dt.timedelta(days=config.days) if config.days else dt.date(1900, 1, 1)
        rows.append(f"(DATE '{c}', DATE '{start}', DATE '{end}')")
    return f"{name}_cut(cutoff, hs, he) AS (VALUES {', '.join(rows)})"


def tables(name: str, config: Config, source: str = "feat", null_safe: bool = False) -> list[str]:
    """Five level tables ``<name>_l0`` .. ``<name>_l4`` over ``<name>_cut``."""
    day = "weekday" if config.day == "weekday" else "day_type"
    history = (
        f"{name}_hist AS (SELECT c.cutoff, f.route_name, f.stop_id, f.{day} AS day_key, "
        f"f.scheduled_minute_of_service_day // {config.minutes} AS slot, f.departure_delay_seconds AS y "
        f"FROM {source} f JOIN {name}_cut c ON f.service_date < c.he AND f.service_date >= c.hs)"
    )
    keys = ["route_name, stop_id, day_key, slot", "route_name, stop_id, slot", "route_name, stop_id", "route_name"]
    levels = [
        f"{name}_l{i} AS (SELECT cutoff, {k}, quantile_cont(y, 0.5) AS m, count(*) AS n FROM {name}_hist "
        f"GROUP BY cutoff, {k} HAVING count(*) >= {config.minimum})"
        for i, k in enumerate(keys)
    ]
    levels.append(f"{name}_l4 AS (SELECT cutoff, quantile_cont(y, 0.5) AS m, count(*) AS n FROM {name}_hist GROUP BY cutoff)")
    return [history, *levels]


def estimates(
    name: str, config: Config, cutoff: str, where: str, source: str = "feat", rows: str | None = None
) -> list[str]:
    """``<name>_pred``: rows of ``rows`` with est, support and depth from the level tables."""
    day = "weekday" if config.day == "weekday" else "day_type"
    questions = (
        f"{name}_q AS (SELECT *, {cutoff} AS cutoff, {day} AS day_key, "
        f"scheduled_minute_of_service_day // {config.minutes} AS slot FROM {rows or source} WHERE {where})"
    )
    keys = [["route_name", "stop_id", "day_key", "slot"], ["route_name", "stop_id", "slot"], ["route_name", "stop_id"], ["route_name"], []]
    joins = " ".join(
        f"LEFT JOIN {name}_l{i} t{i} ON q.cutoff = t{i}.cutoff" + "".join(f" AND q.{k} = t{i}.{k}" for k in ks)
        for i, ks in enumerate(keys)
    )
    found = " ".join(f"WHEN t{i}.m IS NOT NULL THEN {i}" for i in range(5))
    support = " ".join(f"WHEN t{i}.m IS NOT NULL THEN t{i}.n" for i in range(4))
    pred = (
        f"{name}_pred AS (SELECT q.*, coalesce(t0.m, t1.m, t2.m, t3.m, t4.m) AS est, "
        f"CASE {support} WHEN t4.m IS NOT NULL THEN 0 END AS support, CASE {found} END AS depth FROM {name}_q q {joins})"
    )
    return [questions, pred]


def backtest(
    name: str,
    config: Config,
    cutoffs: Sequence[dt.date],
    cutoff: str,
    where: str,
    embargo: int = EMBARGO,
    rows: str | None = None,
) -> list[str]:
    return [
        cut_list(name, config, cutoffs, embargo),
        *tables(name, config),
        *estimates(name, config, cutoff, where, rows=rows),
    ]


WEEK = "CAST(service_date - CAST((day(service_date) - 1) % 7 AS INTEGER) AS DATE)"


def metric_columns(error: str) -> str:
    return f"""CAST(count(*) AS BIGINT) AS rows, round(CAST(avg({error}) AS DOUBLE), 6) AS mae,
    round(sqrt(avg({error} * {error})), 6) AS rmse,
    round(avg(CAST({error} <= 60 AS INTEGER)), 6) AS within_60, round(avg(CAST({error} <= 120 AS INTEGER)), 6) AS within_120,
    round(CAST(quantile_cont({error}, 0.9) AS DOUBLE), 6) AS p90_error"""
