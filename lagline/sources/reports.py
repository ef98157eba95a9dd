"""Aggregates behind the reports, and small JSON / CSV sinks and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def manifest(events: DataFrame) -> DataFrame:
    """Rows and service-date range per file, per archive and overall ('*')."""
    # A null name would be indistinguishable from a subtotal; provenance is never null.
    return (
        events.rollup("source_archive", "source_file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("service_date").alias("minimum_service_date"),
            F.max("service_date").alias("maximum_service_date"),
        )
        .withColumn("source_archive", F.coalesce("source_archive", F.lit("*")))
        .withColumn("source_file", F.coalesce("source_file", F.lit("*")))
    )


def departure_range(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("event_type") == "departure").agg(
        F.min("service_date").alias("departure_date_min"), F.max("service_date").alias("departure_date_max")
    )


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report document: a few rows of nested columns as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
