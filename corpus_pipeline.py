"""A corpus from raw documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.llm import decontamination, exact_dedup, mixing, simhash, toxicity
from lagline.session import run_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored toxic go; the model is fitted on labelled documents of this stage's input."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts linked by fingerprints of three-word shingles within three bits, one stays."""
    return simhash.deduplicate(docs, words_per_shingle=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixing plan: per document its words, its source's target and what each shard draws of it."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

# The first stage is a fitted model; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.select("doc_id", "source", "size", "source_size", "target", "taken", F.to_json("draws").alias("draws"))
