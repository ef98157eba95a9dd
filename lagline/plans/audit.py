"""Audits of backtest detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.operators import audit as A
from lagline.operators import fallback as B
from lagline.operators import metrics as M
from lagline.plans import backtest as T


def development(detail: DataFrame) -> DataFrame:
    return detail.where(F.col("month").isin([F.to_date(F.lit(m)) for m in S.DEVELOPMENT_MONTHS]))


def unseen(features: DataFrame, column: str) -> DataFrame:
    """Values of later splits that training never saw, and the rows they affect."""
    seen = features.where(F.col("data_split") == "train").select(column).distinct()
    counts = (
        features.where(F.col("data_split") != "train")
        .groupBy("data_split", column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(seen, column, "left_anti").groupBy("data_split").agg(
        F.count(F.lit(1)).alias("unseen_values"), F.sum("n").alias("rows_affected")
    )


def three_estimates(features: DataFrame, candidate: B.Config, months: Sequence[str]) -> DataFrame:
    """Monthly baseline, weekly baseline and weekly candidate on each event."""
    base = B.BY_NAME["original_grouped"]
    weeks = B.week_cutoffs(months)
    model = B.fit(features, [(base, B.month_cutoffs(months)), (base, weeks), (candidate, weeks)])
    rows = T.period(features, months)
    asked = rows.withColumn("week", C.week_start(F.col("service_date")))
    cycles = {"month": {"monthly": base}, "week": {"weekly": base, "candidate": candidate}}
    return B.predict_cycles(asked, model, cycles).select(
        *rows.columns,
        F.col("est_monthly").alias("baseline_prediction"),
        F.col("est_weekly").alias("weekly_baseline"),
        F.col("est_candidate").alias("prediction"),
    )


def method_scores(features: DataFrame, candidate: B.Config, months: Sequence[str]) -> DataFrame:
    """Scores of the three methods side by side, per month."""
    methods = F.array(
        F.struct(F.lit("original_grouped").alias("method"), F.col("baseline_prediction").alias("estimate")),
        F.struct(F.lit("weekly_original_grouped").alias("method"), F.col("weekly_baseline").alias("estimate")),
        F.struct(F.lit("selected").alias("method"), F.col("prediction").alias("estimate")),
    )
    long = three_estimates(features, candidate, months).select("month", S.TARGET, F.inline(methods))
    return M.score(M.with_error(long), ["method", "month"])


def gain_table(detail: DataFrame) -> DataFrame:
    return detail.groupBy("month").agg(
        F.avg("error").alias("mae"), F.avg("baseline_error").alias("baseline_mae")
    ).withColumn("gain_percent", (1 - F.col("mae") / F.col("baseline_mae")) * 100)


def final_detail(detail: DataFrame, scorer=M.score) -> DataFrame:
    """The detail with the best development blend as its prediction."""
    weight = A.best_weight(A.blend_scores(detail, scorer)).select("boost_weight")
    blended = detail.withColumn("boost_weight", weight.scalar()).withColumn(
        "prediction", C.blend(F.col("boost_weight"), F.col("prediction"), F.col("baseline_prediction"))
    )
    return T.errors(blended)


def corrected_detail(features: DataFrame, corrected: DataFrame) -> DataFrame:
    """Detail of corrected estimates (event_key, prediction, ...) beside the monthly baseline."""
    months = (*S.DEVELOPMENT_MONTHS, S.AUDIT_MONTH)
    base = T.monthly(features, [B.BY_NAME["original_grouped"]], months).select(
        "event_key", F.col("estimate").alias("baseline_prediction")
    )
    rows = T.period(features, months).join(corrected.select("event_key", "prediction"), "event_key").join(base, "event_key")
    return T.errors(rows).select(*T.DETAIL)


def scores_with_control(final: DataFrame, control: DataFrame, scorer=M.score) -> DataFrame:
    """Scores of the blend per month with its weight, the baseline, the weekly control and the gain."""
    extra = final.groupBy("month").agg(
        F.max("boost_weight").alias("boost_weight"), F.avg("baseline_error").alias("baseline_mae")
    )
    return (
        scorer(final, ["month"])
        .join(extra, "month")
        .join(control.select("month", "weekly_baseline_mae"), "month")
        .withColumn("gain_percent", (1 - F.col("mae") / F.col("baseline_mae")) * 100)
    )


def final_error_tables(final: DataFrame) -> DataFrame:
    """Route errors per month, and hour and weekday errors of the development months, stacked."""
    past = development(final)
    parts = [
        ("route", M.error_table(final, "month", "route_name"), F.concat_ws(" ", "month", "route_name")),
        ("hour", M.error_table(past, "hour"), F.col("hour").cast("string")),
        ("weekday", M.error_table(past, "weekday"), F.col("weekday").cast("string")),
    ]
    stacked = None
    for name, table, key in parts:
        part = table.select(F.lit(name).alias("grouped_by"), key.alias("value"), "rows", "mae", "baseline_mae", "within120")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def final_scores(features: DataFrame, candidate: B.Config, months: Sequence[str], scorer=M.score) -> DataFrame:
    """Scores of the blend with the monthly baseline, the weekly control and the gain."""
    from lagline.sources.work import materialize

    # read by the weight search and again by the scoring
    used = ["month", "scheduled_minute_of_service_day", S.TARGET, "baseline_prediction", "weekly_baseline", "prediction"]
    rows = materialize(three_estimates(features, candidate, months).select(*used), "estimates")
    final = final_detail(T.errors(rows), scorer)
    scores = scorer(final, ["month"])
    extra = final.groupBy("month").agg(
        F.max("boost_weight").alias("boost_weight"),
        F.avg("baseline_error").alias("baseline_mae"),
        F.avg(F.abs(F.col(S.TARGET) - F.col("weekly_baseline"))).alias("weekly_baseline_mae"),
    )
    return scores.join(extra, "month").withColumn(
        "gain_percent", (1 - F.col("mae") / F.col("baseline_mae")) * 100
    )


def weekly_control(features: DataFrame, months: Sequence[str]) -> DataFrame:
    """The baseline refreshed weekly against the baseline refreshed monthly."""
    base = B.BY_NAME["original_grouped"]
    model = B.fit(features, [(base, B.month_cutoffs(months)), (base, B.week_cutoffs(months))])
    asked = T.period(features, months).withColumn("week", C.week_start(F.col("service_date")))
    both = B.predict_cycles(asked, model, {"month": {"monthly": base}, "week": {"weekly": base}})
    cycles = F.array(*[
        F.struct(F.lit(n).alias("cycle"), F.col(f"est_{n}").alias("estimate")) for n in ("monthly", "weekly")
    ])
    scores = M.score(M.with_error(both.select("month", S.TARGET, F.inline(cycles))), ["cycle", "month"])
    found = [F.max(F.when(F.col("cycle") == n, F.col("mae"))).alias(a) for n, a in (("monthly", "baseline_mae"), ("weekly", "weekly_baseline_mae"))]
    return scores.groupBy("month").agg(*found).withColumn(
        "gain_percent", (1 - F.col("weekly_baseline_mae") / F.col("baseline_mae")) * 100
    )


def request_against_backtest(live: DataFrame, detail: DataFrame) -> DataFrame:
    """Live estimates must equal the stored ones of the same event."""
    stored = detail.select(
        "event_key", F.col("baseline_prediction").alias("b"), F.col("prediction").alias("p")
    )
    both = live.join(stored, "event_key")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("baseline_prediction").eqNullSafe(F.col("b"))).alias("baseline_differs"),
        F.count_if(~F.col("est_schedule_slot").eqNullSafe(F.col("p"))).alias("estimate_differs"),
    )
