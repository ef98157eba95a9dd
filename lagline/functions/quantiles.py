"""Exact, interpolated quantiles that survive hot groups.

Two shapes are offered. ``value_counts`` + ``weighted_percentile`` suits measures in whole
(or half) seconds: equal values collapse before the shuffle, the counting shuffle is spread
over (keys, value), and what reaches a group's final state is its *distinct* values, which
the unit of the measure bounds. ``bucket_quantiles`` suits real-valued measures, where
distinct values grow with the rows: only bucket counts meet, and only the buckets that hold
a wanted rank are looked into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(df: DataFrame, keys: Sequence[str], *values: str, n: str | None = None) -> DataFrame:
    """Rows per (keys, values) in column ``n``; pre-counted input passes its count column."""
    count = F.count(F.lit(1)) if n is None else F.sum(n)
    return df.groupBy(*keys, *values).agg(count.alias("n"))


def weighted_percentile(value: str | Column, levels: float | Sequence[float], n: str = "n") -> Column:
    levels = F.lit(levels) if isinstance(levels, (int, float)) else F.array(*map(F.lit, levels))
    return F.percentile(value, levels, F.col(n))


def bucket_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float],
    width: float = 1 / 64,
) -> DataFrame:
    """One row per (keys, level): the same number ``percentile`` gives, for any doubles.

    ``width`` only steers cost: a narrower bucket means more bucket counts and fewer rows
    looked into. The buckets of one group are limited by the range of the measure.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys,
        F.col(value).cast("double").alias("__v"),
        F.floor(F.col(value) / width).cast("bigint").alias("__b"),
    )
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    # Totals add up the bucket counts, whose shuffle is used again: the rows are not read for them.
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    ranked = counts.withColumn("__upto", F.sum("__n").over(by_bucket)).join(totals, keys) if keys else (
        counts.withColumn("__upto", F.sum("__n").over(by_bucket)).withColumn(
            "__total", totals.select("__total").scalar()
        )
    )
    rank = F.col("__level") * (F.col("__total") - 1)
    needed = (
        ranked.withColumn("__before", F.col("__upto") - F.col("__n"))
        .withColumn("__level", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
        .withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn(
            "__rank", F.when(F.col("__side") == 0, F.floor(rank)).otherwise(F.ceil(rank)).cast("bigint")
        )
        .where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__upto")))
        .select(*keys, "__b", "__before", "__level", "__side", "__rank", "__total")
    )
    wanted_buckets = needed.select(*keys, "__b", "__before").distinct()
    inside = rows.join(wanted_buckets, [*keys, "__b"]).groupBy(*keys, "__b", "__before", "__v").agg(
        F.count(F.lit(1)).alias("__n")
    )
    by_value = Window.partitionBy(*keys, "__b").orderBy("__v")
    placed = inside.withColumn("__to", F.sum("__n").over(by_value) + F.col("__before")).withColumn(
        "__from", F.col("__to") - F.col("__n")
    )
    picked = placed.drop("__before", "__n").join(needed.drop("__before"), [*keys, "__b"]).where(
        (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    )
    low = F.max(F.when(F.col("__side") == 0, F.col("__v")))
    high = F.max(F.when(F.col("__side") == 1, F.col("__v")))
    part = F.max(rank - F.floor(rank))
    return picked.groupBy(*keys, F.col("__level").alias("level")).agg(
        (low + (high - low) * part).alias("quantile")
    )
