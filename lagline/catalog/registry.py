"""Where queries and their checks are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lagline.functions import columns as C
from lagline.operators import events as E
from lagline.operators import fallback as B
from lagline.sources.footers import state_mark
from lagline.sources.lineitem import raw_events
from lagline.sources.work import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a query and, where SQL can say the same, its check.

    ``text`` names dates and integers with missing values; both sides print them, so that
    no client library's idea of such a column gets into the comparison.
    """

    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(spark, folder)
            return rounded(result.withColumns({c: F.col(c).cast("string") for c in text}) if text else result)

        QUERIES[name] = run
        if sql is not None:
            printed = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
            ORACLE[name] = f"SELECT * REPLACE ({printed}) FROM (\n{sql}\n)" if text else sql
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a printed precision, as the checks do."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(spark, folder)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return E.derive(raw(spark, folder))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return E.with_day_keys(E.regression_features(clean(spark, folder)))


_made: dict[tuple, object] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Files of the source table with sizes and times: what is kept is valid for this state only."""
    return state_mark(spark, f"{folder}/lineitem.parquet")


def remembered(name: str, build, spark: SparkSession, folder: str):
    """``build(spark, folder)``, once per session and state of the source table."""
    key = (spark.sparkContext.applicationId, folder, name, _state(spark, folder))
    if key not in _made:
        _made[key] = build(spark, folder)
    return _made[key]


def _stored(name: str, build, spark: SparkSession, folder: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    return remembered(name, lambda s, f: materialize(build(s, f), name, partition_by), spark, folder)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The regression features as a written table by month, built once per session and state.

    Backtests, audits and models start from the stored feature table, as they do in
    production; only its first user pays for building it. ``service_month`` is the partition.
    """

    def build(s, f):
        return features(s, f).withColumn(B.MONTH_PARTITION, C.month_start(F.col("service_date")))

    return _stored("features", build, spark, folder, (B.MONTH_PARTITION,))


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    """The ingested events as a written table, for profiles that pass over it repeatedly."""
    return _stored("events", raw, spark, folder)
