"""The document operators as queries over whole tables, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.llm import (
    decontamination,
    exact_dedup,
    language,
    licenses,
    mixing,
    periods,
    pseudonyms,
    quality,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    warc,
)
from lagline.llm.common import documents


# The registered query's key; a deployment passes its own secret.
PSEUDONYM_KEY = "registered query"


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.scores(docs, quality.fit(docs, labels(spark, folder)))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.scores(docs, toxicity.fit(docs, labels(spark, folder)))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.predictions(docs, language.fit(docs))


def op6_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, folder), PSEUDONYM_KEY).select(
        "doc_id", "text", F.size("found").alias("n_replaced"), F.to_json("found").alias("found")
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.findings(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeated(documents(spark, folder))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.notices(documents(spark, folder))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{folder}/pages.parquet"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder), changed=spelling.thinned)


def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.summary(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality,
        op2_toxicity,
        op3_simhash,
        op4_mixing,
        op5_language,
        op6_pseudonyms,
        op7_decontamination,
        op8_substring_dedup,
        op9_exact_dedup,
        op10_licenses,
        op11_warc,
        op12_spelling,
        op13_periods,
    )
}
ORACLE: dict[str, str] = {
    "op4_mixing": mixing.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_warc": warc.SQL,
}


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = pipeline


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
