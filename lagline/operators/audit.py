"""Error audits: day bootstrap, screens, blends, acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.operators.metrics import score

# ---- Fixed values: bootstrap, screen, blend and gate settings --------------------------
DRAWS = 2000
SEED = 42
SCREEN = {"rows": 1000, "mae": 90.0, "within120": 0.75}
BLEND_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
GATE_PERCENT = 5.0


def hashed(*parts: Column) -> Column:
    """A repeatable draw in 0 .. 2^32-1 from a key; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("bigint")


def align(detail: DataFrame, stored: DataFrame, estimate: str = "prediction") -> DataFrame:
    """Bring stored predictions to their events by key, not by position."""
    return detail.join(stored.select("event_key", estimate), "event_key")


def misaligned(detail: DataFrame, stored: DataFrame, same: Sequence[str]) -> DataFrame:
    """Events on one side only, or whose ``same`` columns disagree; all zero when aligned."""
    a = detail.select("event_key", F.struct(*same).alias("a"))
    b = stored.select("event_key", F.struct(*same).alias("b"))
    both = a.join(b, "event_key", "full_outer")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("without_prediction"),
        F.count_if(F.col("a").isNull()).alias("without_event"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("different"),
    )


def day_bootstrap(daily: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Whole-day bootstrap of the MAE gain over the baseline, per month.

    Input is one row per month and day, so the draws (draws x days of the month) are bounded
    by the calendar, not by the events.
    """
    order = Window.partitionBy("month").orderBy("service_date")
    gain = F.col("baseline_error_sum") - F.col("error_sum")
    days = daily.select(
        "month", "rows", gain.alias("gain"), F.row_number().over(order).alias("place")
    )
    months = days.groupBy("month").agg(
        F.count(F.lit(1)).alias("days"),
        (F.sum("gain") / F.sum("rows")).alias("mae_gain"),
        F.count_if(F.col("gain") > 0).alias("days_improved"),
    )
    draw = F.pmod(hashed(F.lit(seed), F.col("month").cast("string"), F.col("rep").cast("string"), F.col("pick").cast("string")), F.col("days")) + 1
    picks = (
        months.select("month", "days", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep"))
        .withColumn("pick", F.explode(F.sequence(F.lit(1), F.col("days").cast("int"))))
        .withColumn("place", draw.cast("int"))
    )
    reps = (
        picks.join(days, ["month", "place"])
        .groupBy("month", "rep")
        .agg((F.sum("gain") / F.sum("rows")).alias("g"))
    )
    bounds = reps.groupBy("month").agg(F.percentile("g", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return months.join(bounds, "month").select(
        "month",
        "mae_gain",
        F.col("q")[0].alias("lower95"),
        F.col("q")[1].alias("upper95"),
        "days_improved",
        "days",
    )


def reliable_routes(
    routes: DataFrame, months: Sequence[str] = tuple(S.DEVELOPMENT_MONTHS), **limits: float
) -> DataFrame:
    """Routes that pass the size and error tests in every development month."""
    limit = {**SCREEN, **limits}
    wanted = F.col("month").isin([F.to_date(F.lit(m)) for m in months])
    return (
        routes.where(wanted)
        .groupBy("route_name")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.min("rows").alias("fewest_rows"),
            F.max("mae").alias("worst_mae"),
            F.min("within120").alias("worst_within120"),
        )
        .where(
            (F.col("months") == len(months))
            & (F.col("fewest_rows") >= limit["rows"])
            & (F.col("worst_mae") <= limit["mae"])
            & (F.col("worst_within120") >= limit["within120"])
        )
    )


def only_routes(detail: DataFrame, routes: DataFrame) -> DataFrame:
    return detail.join(routes.select("route_name"), "route_name", "left_semi")


def subset_audit(detail: DataFrame, routes: DataFrame, month: str = S.AUDIT_MONTH) -> DataFrame:
    """Scores of the screened routes in the audit month and their share of that month's rows."""
    audit = detail.where(F.col("month") == F.to_date(F.lit(month)))
    whole = audit.agg(F.count(F.lit(1)).alias("n"))
    part = score(only_routes(audit, routes), ["month"])
    return part.withColumn("coverage", F.col("rows") / whole.scalar())


def blended(detail: DataFrame, weights: Sequence[float] = tuple(BLEND_WEIGHTS)) -> DataFrame:
    """One row per event and weight of the corrected estimate."""
    return detail.withColumn(
        "boost_weight", F.explode(F.array(*map(F.lit, weights)))
    ).withColumn("prediction", C.blend(F.col("boost_weight"), F.col("prediction"), F.col("baseline_prediction")))


def blend_scores(detail: DataFrame, scorer=score) -> DataFrame:
    """Scores per weight and development month."""
    months = [F.to_date(F.lit(m)) for m in S.DEVELOPMENT_MONTHS]
    rows = blended(detail.where(F.col("month").isin(months)))
    return scorer(
        rows.withColumn("error", F.abs(F.col(S.TARGET) - F.col("prediction"))), ["boost_weight", "month"]
    )


def best_weight(scores: DataFrame) -> DataFrame:
    means = scores.groupBy("boost_weight").agg(F.avg("mae").alias("mae"))
    return means.agg(
        F.min_by("boost_weight", F.struct("mae", "boost_weight")).alias("boost_weight"), F.min("mae").alias("mae")
    )


def gains(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Percent improvement of the MAE per month."""
    a = candidate.select("month", F.col("mae"))
    b = baseline.select("month", F.col("mae").alias("baseline_mae"))
    return a.join(b, "month").withColumn("gain_percent", (1 - F.col("mae") / F.col("baseline_mae")) * 100)


def gate(gain: DataFrame, months: Sequence[str] = tuple(S.DEVELOPMENT_MONTHS)) -> DataFrame:
    """Two readings of the acceptance rule: mean of gains, and gain of means."""
    dev = gain.where(F.col("month").isin([F.to_date(F.lit(m)) for m in months]))
    every = F.bool_and(F.col("gain_percent") > 0)
    mean_of_gains = F.avg("gain_percent")
    gain_of_means = (1 - F.avg("mae") / F.avg("baseline_mae")) * 100
    return dev.agg(
        mean_of_gains.alias("mean_of_gains"),
        gain_of_means.alias("gain_of_means"),
        every.alias("better_every_month"),
        ((mean_of_gains >= GATE_PERCENT) & every).alias("search_gate_passed"),
        ((gain_of_means >= GATE_PERCENT) & every).alias("audit_gate_passed"),
    )
