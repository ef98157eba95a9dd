"""From archives to clean events to feature tables, each step written and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.operators import contracts as Q
from lagline.operators import events as E
from lagline.sources import archives
from lagline.sources.reports import departure_range, manifest, write_report
from lagline.sources.tables import write_checked


def ingest(spark: SparkSession, folder: str, output: str, report: str | None = None) -> DataFrame:
    """Archives to one typed event table with provenance, plus a manifest."""
    events = archives.read_archives(spark, folder)
    write_checked(events, output)
    table = spark.read.schema(S.EVENT_SCHEMA).parquet(output)
    if report:
        write_report(manifest(table), report)
    return table


def clean(spark: SparkSession, source: str, output: str, report: str | None = None) -> DataFrame:
    """Validate every event, append the analysis columns, change nothing."""
    events = spark.read.parquet(source)
    Q.require_exact_columns(events, S.PROVENANCE + S.RAW_COLUMNS)
    counts = Q.enforce(events, Q.event_rules())
    write_checked(E.derive(events), output, expected_rows=counts["rows"])
    table = spark.read.schema(S.CLEAN_SCHEMA).parquet(output)
    if report:
        facts = Q.cleaning_counters(table).select(
            F.lit(counts["rows"]).alias("input_rows"),
            F.lit(0).alias("rows_removed"),
            F.struct("*").alias("flag_counts"),
        )
        write_report(facts, report)
    return table


def features(
    spark: SparkSession,
    source: str,
    regression: str,
    classification: str,
    report: str | None = None,
    validation_start: str = S.VALIDATION_START,
    test_start: str = S.TEST_START,
) -> tuple[DataFrame, DataFrame]:
    """Regression and classification tables, split by date; unknown labels are refused."""
    table = spark.read.parquet(source)
    Q.require_columns(table, S.CLEAN_SCHEMA.names)
    unknown = Q.unexpected_statuses(table)
    n = unknown.count()
    if n:
        shown = unknown.orderBy(*unknown.columns).limit(20).collect()
        raise Q.ContractError({"unexpected_statuses": n}, [r.asDict() for r in shown])
    numeric = E.regression_features(table, validation_start, test_start)
    labelled = E.classification_features(table, validation_start, test_start)
    Q.enforce(numeric, Q.split_rules(S.TARGET))
    Q.enforce(labelled, Q.split_rules(S.CLASS_TARGET))
    write_checked(numeric, regression)
    write_checked(labelled, classification)
    numeric, labelled = spark.read.parquet(regression), spark.read.parquet(classification)
    if report:
        counted = Q.feature_counters(numeric, S.TARGET).withColumn("table_name", F.lit("regression")).unionByName(
            Q.feature_counters(labelled, S.CLASS_TARGET, classes=True).withColumn("table_name", F.lit("classification"))
        )
        facts = counted.groupBy("table_name").agg(
            F.map_from_entries(F.collect_list(F.struct("counter", "rows"))).alias("counts")
        )
        span = departure_range(table).select(F.struct("*").alias("departures"))
        write_report(facts.withColumn("departures", span.scalar()), report)
    return numeric, labelled
