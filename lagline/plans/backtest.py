"""Chronological backtests: every candidate, month and refresh week in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.operators import fallback as B
from lagline.operators.metrics import score
from lagline.sources.work import materialize

WEEKLY = "_weekly"  # marks the weekly cycle of a candidate
CROSS_FIT = ["original_grouped", "schedule_slot", "day_type"]


def period(features: DataFrame, months: Sequence[str]) -> DataFrame:
    wanted = F.lit(False)
    for month in months:
        wanted = wanted | C.in_months(F.col("service_date"), month)
    rows = features.where(wanted)
    if B.MONTH_PARTITION in features.columns:  # a filter the scan can turn into a choice of folders
        rows = rows.where(F.col(B.MONTH_PARTITION).isin(sorted({dt.date.fromisoformat(m).replace(day=1) for m in months})))
    return rows.withColumn("month", C.month_start(F.col("service_date"))).drop(B.MONTH_PARTITION)


def monthly(features: DataFrame, configs: Sequence[B.Config], months: Sequence[str]) -> DataFrame:
    """Estimates refreshed at each month start; one row per event and candidate."""
    model = B.fit(features, [(c, B.month_cutoffs(months)) for c in configs])
    return B.predict_long(period(features, months), model, configs, F.col("month"))


def weekly(features: DataFrame, configs: Sequence[B.Config], months: Sequence[str]) -> DataFrame:
    """Estimates refreshed every seven days, counted from each month start."""
    model = B.fit(features, [(c, B.week_cutoffs(months)) for c in configs])
    return B.predict_long(period(features, months), model, configs, C.week_start(F.col("service_date")))


def grid(features: DataFrame, configs: Sequence[B.Config], months: Sequence[str]) -> DataFrame:
    """Rows to score per candidate and month."""
    counts = period(features, months).groupBy("month").agg(F.count(F.lit(1)).alias("rows"))
    names = F.array(*[F.lit(c.name) for c in configs])
    return counts.select("month", "rows", F.explode(names).alias("candidate"))


def history_windows(
    features: DataFrame, plans: Sequence[tuple[B.Config, Sequence]], embargo: int = S.EMBARGO_DAYS
) -> DataFrame:
    """Rows and days inside the history of every candidate and cutoff.

    Events are counted per day first; the windows meet days, never events.
    """
    days = features.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"))
    rows = [
        (c.name, cutoff, w.start, w.hist_end)
        for c, cutoffs in plans
        for cutoff, w in zip(cutoffs, B.windows_for(c, cutoffs, embargo))
    ]
    windows = features.sparkSession.createDataFrame(
        rows, "candidate string, cutoff date, hist_start date, hist_end date"
    )
    inside = (F.col("service_date") < F.col("hist_end")) & (
        F.col("hist_start").isNull() | (F.col("service_date") >= F.col("hist_start"))
    )
    return days.join(F.broadcast(windows), inside).groupBy("candidate", "cutoff").agg(
        F.sum("n").alias("rows"), F.min("service_date").alias("first_day"), F.max("service_date").alias("last_day")
    )


def pivoted_gains(scores: DataFrame, names: Sequence[str], original: str = "original_grouped") -> DataFrame:
    """One row per month: every candidate's MAE and its percent gain over the original."""
    wide = scores.groupBy("month").pivot("candidate", list(names)).agg(F.max("mae"))
    return wide.select(
        "month",
        *names,
        *[((1 - F.col(n) / F.col(original)) * 100).alias(f"gain_{n}") for n in names if n != original],
    )


def scored(predicted: DataFrame) -> DataFrame:
    return score(
        predicted.withColumn("error", F.abs(F.col(S.TARGET) - F.col("estimate"))), ["candidate", "month"]
    )


def candidate_summary(scores: DataFrame) -> DataFrame:
    """Equal-month means, best candidate first."""
    return (
        scores.groupBy("candidate")
        .agg(
            F.avg("mae").alias("mean_month_mae"),
            F.max("mae").alias("worst_month_mae"),
            F.avg("within_120").alias("within_120"),
        )
        .orderBy("mean_month_mae", "candidate")
    )


def best(summary: DataFrame, name: str = "candidate", metric: str = "mean_month_mae") -> DataFrame:
    """The lowest metric; the first label wins a tie."""
    return summary.agg(
        F.min_by(name, F.struct(metric, name)).alias(name), F.min(metric).alias(metric)
    )


@dataclass(frozen=True)
class Selection:
    """What won over both refresh cycles, and every score it was chosen from."""

    scores: DataFrame
    first: B.Config  # winner of the monthly cycle, the one that was also refreshed weekly
    config: B.Config
    refresh: str

    @property
    def name(self) -> str:
        return self.config.name + WEEKLY * (self.refresh == "week")


def select_cycles(
    features: DataFrame,
    configs: Sequence[B.Config] = tuple(B.CANDIDATES),
    months: Sequence[str] = tuple(S.DEVELOPMENT_MONTHS),
    first: DataFrame | None = None,
) -> Selection:
    """Grid, then the weekly cycle of the grid's winner, then the best of both cycles.

    ``first`` may hold the grid's scores where they exist already.
    """
    named = {c.name: c for c in configs}
    first = materialize(scored(monthly(features, configs, months)), "monthly-scores") if first is None else first
    leader = named[best(candidate_summary(first)).first()["candidate"]]
    second = scored(weekly(features, [leader], months)).withColumn("candidate", F.lit(leader.name + WEEKLY))
    scores = first.unionByName(materialize(second, "weekly-scores"))
    winner = best(candidate_summary(scores)).first()["candidate"]
    refresh = "week" if winner == leader.name + WEEKLY else "month"
    return Selection(scores, leader, leader if refresh == "week" else named[winner], refresh)


def final_model(features: DataFrame, selection: Selection, cutoff: str = S.FINAL_CUTOFF) -> DataFrame:
    """Level tables of the selected candidate on all history before the last cutoff's embargo."""
    return B.fit(features, [(selection.config, [dt.date.fromisoformat(cutoff)])])


def cross_fitted_history(features: DataFrame, months: Sequence[str] = S.CROSS_FIT_MONTHS) -> DataFrame:
    """Each event with three estimates made only from history before its own week."""
    configs = [B.BY_NAME[n] for n in CROSS_FIT]
    model = B.fit(features, [(c, B.week_cutoffs(months)) for c in configs])
    wide = B.predict_wide(period(features, months), model, configs, C.week_start(F.col("service_date")))
    return wide.withColumn("support_log", F.log1p("support_schedule_slot")).withColumn(
        "depth", F.col("depth_schedule_slot")
    ).drop(*[f"{p}_{n}" for n in CROSS_FIT for p in ("support", "depth")])


# Columns of an audit's detail.
DETAIL = [
    "event_key",
    "month",
    "service_date",
    "route_name",
    "weekday",
    "scheduled_minute_of_service_day",
    "hour",
    S.TARGET,
    "prediction",
    "baseline_prediction",
    "error",
    "baseline_error",
    "within120",
]


def audit_detail(
    features: DataFrame,
    candidate: B.Config,
    refresh: str = "month",
    months: Sequence[str] = (*S.DEVELOPMENT_MONTHS, S.AUDIT_MONTH),
) -> DataFrame:
    """Each event of the months with the candidate's and the baseline's estimate and errors.

    The baseline is the original grouping refreshed monthly; the candidate may be refreshed
    weekly. Both sit on the same row, so nothing has to be aligned afterwards.
    """
    base = B.BY_NAME["original_grouped"]
    cutoffs = B.week_cutoffs(months) if refresh == "week" else B.month_cutoffs(months)
    model = B.fit(features, [(base, B.month_cutoffs(months)), (candidate, cutoffs)])
    rows = period(features, months).withColumn("week", C.week_start(F.col("service_date")))
    cycles = {"month": {"baseline": base}}
    cycles.setdefault("week" if refresh == "week" else "month", {})["candidate"] = candidate
    both = B.predict_cycles(rows, model, cycles).withColumnsRenamed(
        {"est_baseline": "baseline_prediction", "est_candidate": "prediction"}
    )
    return errors(both).select(*DETAIL)


def errors(detail: DataFrame) -> DataFrame:
    """Absolute errors of both estimates, the two-minute flag and the service hour."""
    target = F.col(S.TARGET)
    return detail.withColumns(
        {
            "error": F.abs(target - F.col("prediction")),
            "baseline_error": F.abs(target - F.col("baseline_prediction")),
            "within120": F.abs(target - F.col("prediction")) <= 120,
            "hour": C.service_hour(F.col("scheduled_minute_of_service_day")),
        }
    )
