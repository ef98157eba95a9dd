"""Predictor encodings fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from lagline import schema as S
from lagline.functions.columns import filled
from lagline.sources.work import materialize

RARE_BELOW = 20
INFREQUENT = "<INFREQUENT>"


def category_counts(training: DataFrame, columns: Sequence[str] = tuple(S.CATEGORICAL)) -> DataFrame:
    """(field, value, n) of every category in training, missing as its own value."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), filled(F.col(c)).alias("value")) for c in columns])
    return training.select(F.inline(cells)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def numeric_moments(training: DataFrame, columns: Sequence[str] = tuple(S.NUMERICAL)) -> DataFrame:
    """(field, mean, spread); the spread is that of the whole training population."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns
    ])
    return training.select(F.inline(cells)).groupBy("field").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")
    )


@dataclass
class Encoder:
    """One-hot categories with a rare bucket, unknown ones all zero; numbers standardised.

    Known labels and moments are as wide as the model's coefficient vector, which a linear or
    tree model keeps on the driver in any case. Rare categories are a table (field, value) that
    meets the rows in a join, however many there are; ``has_rare`` names the fields with any.
    """

    known: dict[str, list[str]]
    rare: DataFrame
    has_rare: set[str]
    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, training: DataFrame, rare_below: int = RARE_BELOW) -> Encoder:
        counts = materialize(category_counts(training), "categories")
        known = {c: [] for c in S.CATEGORICAL}
        for row in counts.where(F.col("n") >= rare_below).orderBy("field", "value").collect():
            known[row["field"]].append(row["value"])
        rare = counts.where(F.col("n") < rare_below).select("field", "value")
        has_rare = {r["field"] for r in rare.select("field").distinct().collect()}
        moments = {
            r["field"]: (r["mean"], r["spread"] or 1.0) for r in numeric_moments(training).collect()
        }
        return cls(known, rare, has_rare, moments)

    def labels(self, column: str) -> list[str]:
        return self.known[column] + ([INFREQUENT] if column in self.has_rare else [])

    def field_of_position(self) -> list[str]:
        fields = [c for c in S.CATEGORICAL for _ in self.labels(c)]
        return fields + list(S.NUMERICAL)

    def indexed(self, rows: DataFrame) -> DataFrame:
        """Append ``__<category>_index``: the place of its label, one more for unknown values."""
        prepared = rows.withColumns({f"__{c}": filled(F.col(c)) for c in S.CATEGORICAL})
        for c in sorted(self.has_rare):
            infrequent = self.rare.where(F.col("field") == c).select(F.col("value").alias(f"__rare_{c}"))
            prepared = prepared.join(infrequent, F.col(f"__{c}") == F.col(f"__rare_{c}"), "left").withColumn(
                f"__{c}", F.when(F.col(f"__rare_{c}").isNotNull(), INFREQUENT).otherwise(F.col(f"__{c}"))
            )
        for c in S.CATEGORICAL:
            prepared = StringIndexerModel.from_labels(
                self.labels(c), inputCol=f"__{c}", outputCol=f"__{c}_index", handleInvalid="keep"
            ).transform(prepared)
        return prepared

    def transform(self, rows: DataFrame) -> DataFrame:
        """Append the ``features`` vector."""
        indexed = self.indexed(rows).withColumns({
            f"__{c}": (F.col(c).cast("double") - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1])
            for c in S.NUMERICAL
        })
        # "keep" gives unknown values one more index; dropping the last makes them all zero.
        encoder = OneHotEncoder(
            inputCols=[f"__{c}_index" for c in S.CATEGORICAL],
            outputCols=[f"__{c}_hot" for c in S.CATEGORICAL],
            dropLast=True,
        ).fit(indexed)
        hot = encoder.transform(indexed)
        assembled = VectorAssembler(
            inputCols=[f"__{c}_hot" for c in S.CATEGORICAL] + [f"__{c}" for c in S.NUMERICAL],
            outputCol="features",
        ).transform(hot)
        return assembled.select(*rows.columns, "features")


def ordinal_codes(training: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Per column a (value, code) table: sorted distinct training values, from 0.

    Values are sorted by ranges; a code is the place within the range plus the sizes of the
    ranges before it, so no task sees all values.
    """
    tables = {}
    for c in columns:
        values = training.select(filled(F.col(c)).alias("value")).distinct()
        ranged = values.repartitionByRange("value").sortWithinPartitions("value")
        place = F.monotonically_increasing_id()  # range number in the upper bits, place in the lower 33
        ranged = materialize(ranged.select("value", place.alias("id")), f"ordinal-{c}")
        ranged = ranged.select(
            "value", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
        )
        sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        tables[c] = ranged.join(starts, "range").select("value", (F.col("start") + F.col("at")).cast("double").alias("code"))
    return tables


def encode_ordinal(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Append ``code_<column>``; a value unseen in training has no code."""
    for c, table in tables.items():
        lookup = table.select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"code_{c}"))
        rows = rows.join(lookup, filled(F.col(c)) == F.col(f"__{c}"), "left").drop(f"__{c}")
    return rows
