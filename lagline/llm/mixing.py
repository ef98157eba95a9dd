"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Sources (by code point, null last) weigh 3, 1, 2 and so on in turn and share 150 % of all
words; a target stops at twice its source's size and the excess is shared again by weight. A
keyed hash permutes each source and cuts it into 256 blocks, its first two hex digits. Target
words are whole passes over the source, then whole blocks, then one block in part: that one is
cut by two more digits, and only one piece of it is ordered row by row, so no source meets in
one task. The drawn blocks of all sources are then dealt to output shards: a tree halves the
shards, at each node a draw without replacement splits the exact block quotas of every source
between the two halves, and each shard takes its quota from the source's permuted blocks,
disjoint from the others'. Within a shard rows are ordered by a hash of their own.

Only DataFrame functions are used. Tables of sources, blocks and quotas have a bounded number
of rows per source. Nulls: a null text has no words, a null source is a source of its own, a
null ``doc_id`` is hashed as the empty word. Rows that repeat a ``doc_id`` stand side by side
and are drawn like others. No words at all give targets of 0; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.sources.work import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SHARDS = 8
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(word_count(F.col("text"))).cast("long").alias("size"),
        key.alias("key"),
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): one row per source of ``sources`` (source, source_size).

    Sorted by the level at which they reach their cap, the sources before the first one that
    stays below it are full; what they leave is shared by weight among the others.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.select("source", "source_size", place.alias("place"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = W.orderBy("full_at", "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after)).withColumn("rank", F.row_number().over(order))
    chosen = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rank", "level"))).over(everything)["level"]
    return rows.withColumn("chosen", chosen).select(
        "source",
        "source_size",
        F.round(
            F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("chosen") * F.col("weight"), F.lit(float("inf")))), 6
        ).alias("target"),
    )


def _shares(pieces: DataFrame, keys: Sequence[str], piece: str) -> DataFrame:
    """How many of the ``rest`` words each piece gives when pieces are taken in order."""
    before = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    given = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    return pieces.withColumn("given", F.greatest(F.lit(0), F.least("words", given)).cast("long"))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null equals null; the keys come from ``a``."""
    other = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return a.join(other, condition, how).drop(*(f"other_{k}" for k in keys))


def dealt(drawn: DataFrame, shards: int, seed: str) -> DataFrame:
    """The shard of each drawn block (source, block, turn), by the splitting tree."""
    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")

    def noise(*parts):
        return F.md5(F.concat_ws(":", F.lit(seed), *(p if isinstance(p, Column) else F.lit(p) for p in parts)))

    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    order = W.partitionBy("source").orderBy(noise("deal", name, F.col("turn"), F.col("block")))
    blocks = drawn.withColumn("ticket", F.row_number().over(order))
    tree = blocks.select("source", "ticket", F.lit(0).alias("node"))
    for level in range(shards.bit_length() - 1):
        within = W.partitionBy("node")
        rank = F.row_number().over(within.orderBy(noise(f"level{level}", name, F.col("ticket"))))
        left = F.ceil(F.count(F.lit(1)).over(within) / 2)
        tree = tree.select("source", "ticket", "node", rank.alias("rank"), left.alias("left_size"))
        tree = tree.select("source", "ticket", (F.col("node") * 2 + (F.col("rank") > F.col("left_size")).cast("int")).alias("node"))
    # Only the counts leave the tree: the quota of every source in every shard.
    quotas = tree.groupBy("source", "node").agg(F.count(F.lit(1)).alias("quota"))
    upto = F.sum("quota").over(W.partitionBy("source").orderBy("node"))
    quotas = quotas.withColumn("upto", upto).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("upto", "node"))).alias("quotas"))
    joined = _joined(blocks, quotas, ["source"])
    shard = F.filter("quotas", lambda q: q["upto"] >= F.col("ticket"))[0]["node"]
    return joined.select("source", "block", "turn", shard.alias("shard"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document with its source's size and target and what the mix draws of it.

    ``draws`` holds per drawing of the document its shard, the words taken (from the start of
    the text) and the place within the shard; ``taken`` is their sum, at most twice the size.
    """
    rows = materialize(sized(docs, seed), "mix-sizes")
    rows = rows.withColumn("block", F.substring("key", 1, 2)).withColumn("piece", F.substring("key", 3, 2))
    blocks = materialize(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    plan = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = F.round("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("turns", turns).withColumn("rest", goal - F.col("turns") * F.col("source_size"))
    plan = materialize(plan, "mix-targets")
    shares = materialize(_shares(_joined(blocks, plan, ["source"]), ["source"], "block"), "mix-shares")

    each_turn = F.explode(F.sequence(F.lit(0), F.col("turns")))
    drawn = shares.select("source", "block", "words", "turns", "given", each_turn.alias("turn"))
    drawn = drawn.where(F.when(F.col("turn") < F.col("turns"), F.col("words")).otherwise(F.col("given")) > 0)
    deals = dealt(drawn.select("source", "block", "turn"), shards, seed)
    deals = deals.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("deals"))
    table = materialize(_joined(shares, deals, ["source", "block"], "left"), "mix-deals")

    known = _joined(rows, table, ["source", "block"])
    in_part = (F.col("given") > 0) & (F.col("given") < F.col("words"))
    whole = known.where(~in_part).withColumn("last", F.when(F.col("given") > 0, F.col("size")).otherwise(F.lit(0)))
    part = known.where(in_part).withColumn("rest", F.col("given")).drop("words", "given")
    pieces = part.groupBy("source", "block", "piece").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    pieces = _shares(pieces, ["source", "block"], "piece").select("source", "block", "piece", "words", "given")
    cut = _joined(part, pieces, ["source", "block", "piece"])
    edge = (F.col("given") > 0) & (F.col("given") < F.col("words"))
    inside = cut.where(~edge).withColumn("last", F.when(F.col("given") > 0, F.col("size")).otherwise(F.lit(0)))
    before = W.partitionBy("source", "block", "piece").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    taken = F.col("given") - F.coalesce(F.sum("size").over(before), F.lit(0))
    at_edge = cut.where(edge).withColumn("last", F.greatest(F.lit(0), F.least("size", taken)))
    columns = ["doc_id", "source", "size", "source_size", "target", "key", "turns", "last", "deals"]
    every = whole.select(*columns).union(inside.select(*columns)).union(at_edge.select(*columns))
    draws = F.transform(
        F.coalesce("deals", F.array().cast("array<struct<turn:bigint,shard:int>>")),
        lambda d: F.struct(
            d["shard"].alias("shard"),
            F.when(d["turn"] < F.col("turns"), F.col("size")).otherwise(F.col("last")).cast("long").alias("words"),
            F.md5(F.concat_ws(":", F.lit(seed), d["turn"].cast("string"), F.col("key"))).alias("place"),
        ),
    )
    every = every.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    total = F.aggregate("draws", F.lit(0).cast("long"), lambda sum_, d: sum_ + d["words"])
    return every.select("doc_id", "source", "size", "source_size", "target", total.alias("taken"), "draws")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s
), f AS (
  SELECT *, 2 * source_size / weight AS full_at FROM w
), l AS (
  SELECT *, row_number() OVER o AS rank,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - 2 * coalesce(sum(source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f WINDOW o AS (ORDER BY full_at, place)
), c AS (
  SELECT arg_min(level, rank) AS chosen FROM l WHERE level <= full_at
), g AS (
  SELECT source, source_size,
         round(least(2.0::DOUBLE * source_size, coalesce(chosen * weight, 'inf'::DOUBLE)), 6) AS target
  FROM l CROSS JOIN c
), t AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS turns,
         round(target)::BIGINT AS goal
  FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turns, t.goal - t.turns * t.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (turns * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM r
"""
