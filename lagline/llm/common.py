"""What the document operators share: narrow inputs, byte words, arrow batches.

Conventions of every operator here: extra columns of the input are ignored (only the named
ones are selected, so clashing names cannot reach a plan), a null text counts as empty, a
null ``doc_id`` sorts behind all others, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

NO_ID = 9223372036854775807  # stands for a null doc_id inside the operators: behind all others
SPACES = b" \t\n\x0b\x0c\r"  # the white space of all word rules; bytes.split() splits on exactly these


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def narrow(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) with the text as UTF-8 bytes and null text as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def arrow_rows(
    make: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: pa.Schema
) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """Turn a function from batches to column dictionaries into a mapInArrow function."""

    def run(batches):
        for columns in make(iter(batches)):
            if len(next(iter(columns.values()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
                )

    return run
