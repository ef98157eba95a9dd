"""Error metrics of estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lagline import schema as S
from lagline.functions.quantiles import bucket_quantiles, value_counts, weighted_percentile


def with_error(predicted: DataFrame, estimate: str = "estimate") -> DataFrame:
    error = F.abs(F.col(S.TARGET) - F.col(estimate))
    return predicted.withColumn("error", error).withColumn("within120", error <= 120)


def _within(limit: int, n: Column, rows: Column) -> Column:
    return F.sum(F.when(F.col("error") <= limit, n).otherwise(0)) / rows


def score(predicted: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Rows, MAE, RMSE, shares within 60 and 120 s, 90 % quantile of the error.

    For estimates that are medians of whole seconds: errors are half seconds, so the equal
    ones are counted together first and the quantile stays exact.
    """
    counts = value_counts(predicted.withColumn("error", F.col(error)), keys, "error")
    n, e = F.col("n"), F.col("error")
    rows = F.sum(n)
    return counts.groupBy(*keys).agg(
        rows.alias("rows"),
        (F.sum(e * n) / rows).alias("mae"),
        F.sqrt(F.sum(e * e * n) / rows).alias("rmse"),
        _within(60, n, rows).alias("within_60"),
        _within(120, n, rows).alias("within_120"),
        weighted_percentile("error", 0.9).alias("p90_error"),
    )


def score_real(predicted: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """The same measures for real-valued estimates, whose errors hardly ever repeat."""
    e = F.col(error)
    one = F.lit(1)
    rows = F.count(one)
    sums = predicted.groupBy(*keys).agg(
        rows.alias("rows"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((e <= 60).cast("int")).alias("within_60"),
        F.avg((e <= 120).cast("int")).alias("within_120"),
    )
    p90 = bucket_quantiles(predicted, keys, error, [0.9]).select(*keys, F.col("quantile").alias("p90_error"))
    return sums.join(p90, list(keys), "left") if keys else sums.withColumn("p90_error", p90.select("p90_error").scalar())


def regression_metrics(predicted: DataFrame, keys: Sequence[str], estimate: str = "estimate") -> DataFrame:
    """Rows, MAE, RMSE and R squared."""
    y = F.col(S.TARGET).cast("double")
    error = y - F.col(estimate)
    return predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluation_rows"),
        F.avg(F.abs(error)).alias("mae_seconds"),
        F.sqrt(F.avg(error * error)).alias("rmse_seconds"),
        (1 - F.sum(error * error) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
    )


def error_quantiles(predicted: DataFrame, keys: Sequence[str], error: str = "error", real: bool = False) -> DataFrame:
    """Median, 90 %, 95 % and 99 % of the absolute error."""
    levels = [0.5, 0.9, 0.95, 0.99]
    names = ["median_error", "p90_error", "p95_error", "p99_error"]
    if real:
        long = bucket_quantiles(predicted, keys, error, levels)
        return long.groupBy(*keys).agg(
            *[F.max(F.when(F.col("level") == p, F.col("quantile"))).alias(a) for p, a in zip(levels, names)]
        )
    q = weighted_percentile(error, levels)
    return value_counts(predicted, keys, error).groupBy(*keys).agg(
        *[q[i].alias(a) for i, a in enumerate(names)]
    )


def daily_errors(detail: DataFrame) -> DataFrame:
    return detail.groupBy("month", "service_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("error").alias("error_sum"),
        F.sum("baseline_error").alias("baseline_error_sum"),
    )


def error_table(detail: DataFrame, *keys: str) -> DataFrame:
    """Rows, MAE, baseline MAE and share within 120 s per key."""
    return detail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("error").alias("mae"),
        F.avg("baseline_error").alias("baseline_mae"),
        F.avg(F.col("within120").cast("int")).alias("within120"),
    )
