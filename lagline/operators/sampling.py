"""Seeded samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 1 << 16


def draw(key: Column, seed: int) -> Column:
    """32 hex digits per row: the order in which rows are drawn."""
    return F.md5(F.concat_ws("-", key, F.lit(str(seed))))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest draws; all rows if there are fewer.

    The draw's first 16 bits cut the rows into buckets. Whole buckets below the one where
    the n-th row falls pass by a plain filter; only that bucket is ranked, so no task sees
    more than about one in 65,536 rows.
    """
    drawn = df.withColumn("__draw", draw(F.col(key), seed)).withColumn(
        "__bucket", F.conv(F.substring("__draw", 1, 4), 16, 10).cast("int")
    )
    sizes = drawn.groupBy("__bucket").agg(F.count(F.lit(1)).alias("size"))
    # at most 65,536 rows, whatever the input
    upto = sizes.withColumn("upto", F.sum("size").over(Window.orderBy("__bucket")))
    last = upto.where(F.col("upto") >= n).agg(
        F.min(F.struct(F.col("__bucket").alias("bucket"), (F.col("upto") - F.col("size")).alias("before"))).alias("c")
    )
    cut = drawn.withColumn("__c", last.scalar())
    below = cut.where(F.col("__c").isNull() | (F.col("__bucket") < F.col("__c.bucket")))
    edge = (
        cut.where(F.col("__bucket") == F.col("__c.bucket"))
        .withColumn("__place", F.row_number().over(Window.partitionBy("__bucket").orderBy("__draw", key)))
        .where(F.col("__place") <= n - F.col("__c.before"))
    )
    return below.select(*df.columns).unionByName(edge.select(*df.columns))
