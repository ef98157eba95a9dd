"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.sources.work import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its smallest node.

    Each round rewrites the links so that nodes point at smaller and smaller neighbours; the
    number of rounds grows with the logarithm of the number of nodes. Minima are aggregated
    before they meet, and the joins are plain equality joins that adaptive execution can split
    at a hub. Links of a node with itself and null ends are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("s"))
            .select(F.col("s.x").alias("a"), F.col("s.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = materialize(small, "small-star")
        if not _differ(edges, small):
            return _labels(small)
        edges = small


def _differ(one: DataFrame, other: DataFrame) -> bool:
    def mark(df):
        return df.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()

    return mark(one) != mark(other)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select("b", "b").distinct()
    )
