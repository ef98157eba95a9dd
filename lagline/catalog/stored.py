"""Sinks and sources as queries: what is written and read again must be what went in."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog import backtests as X
from lagline.catalog import registry as R
from lagline.catalog.prelude import over
from lagline.operators import fallback as B
from lagline.session import run_folder
from lagline.sources import archives, reports, tables
from lagline.sources.work import materialize


def _place(spark, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _again(name: str, source: str):
    """Register ``name``: the result of ``source`` sent through a sink, under the same SQL check."""

    def add(through):
        def run(spark, folder):
            return through(spark, R.QUERIES[source](spark, folder))

        R.QUERIES[name], R.ORACLE[name] = run, R.ORACLE[source]
        return through

    return add


@_again("s7_written_table", "p18_regression_features")
def _(spark, result):
    """Twice to one path, so that the second write replaces a table; rows and columns are verified."""
    path = _place(spark, "written")
    rows = tables.write_checked(result, path)
    tables.write_checked(result, path, expected_rows=rows)
    return spark.read.schema(result.schema).parquet(path)


@_again("s14_summary_csv", "a1a_route_summary")
def _(spark, result):
    path = _place(spark, "summary")
    reports.write_summary_csv(result, path)
    return reports.read_summary_csv(spark, path, result.schema)


@_again("s15_report_json", "a6_numeric_profile")
def _(spark, result):
    path = _place(spark, "report")
    reports.write_report(result, path)
    return reports.read_report(spark, path, result.schema)


@_again("s18_detail_by_month", "m24_audit_detail")
def _(spark, result):
    path = _place(spark, "detail")
    tables.write_checked(result, path, partition_by=["month"])
    return spark.read.schema(result.schema).parquet(path)


@_again("s20_cached_history", "m19_cross_fitted_history")
def _(spark, result):
    """The second call must find the first one's table, or it would build from nothing."""
    source, path = materialize(result, "history-result"), _place(spark, "cached")
    tables.cached_table(source, path, lambda df: df)
    return tables.cached_table(source, path, lambda df: df.limit(0))


@R.query("s12b_stored_split", R.ORACLE["s12_load_split"])
def _(spark, folder):
    """One split of a stored table that is partitioned by split: the filter chooses folders."""

    def build(s, f):
        path = _place(s, "features-by-split")
        tables.write_checked(R.features(s, f), path, partition_by=["data_split"])
        return path

    path = R.remembered("features-by-split", build, spark, folder)
    return _shape(tables.load_split(spark, path, "validation"), R.QUERIES["s12_load_split"](spark, folder).columns)


def _shape(rows, columns):
    return rows.withColumn("service_date", F.col("service_date").cast("string")).select(*columns)


@R.query("s19_stored_model", R.ORACLE["a20_grouped_medians"])
def _(spark, folder):
    """A fallback model read from its stored level tables, with the settings it was fitted under."""
    path = _place(spark, "model")
    B.save(B.fit(R.feature_table(spark, folder), [(X.ORIGINAL, B.month_cutoffs(["2026-05-01"]))]), [X.ORIGINAL], path)
    model, (config,) = B.load(spark, path)
    return X.levels_of(model, config)


@R.query("m30_later_outcomes_do_not_matter", R.ORACLE["a20_grouped_medians"])
def _(spark, folder):
    """The same tables, although every outcome inside the embargo or after it is another one."""
    end = dt.date(2026, 5, 1) - dt.timedelta(days=S.EMBARGO_DAYS)
    later = F.col("service_date") >= F.lit(end)
    changed = R.feature_table(spark, folder).withColumn(S.TARGET, F.when(later, F.col(S.TARGET) * 100 + 7).otherwise(F.col(S.TARGET)))
    return X.levels_of(B.fit(changed, [(X.ORIGINAL, B.month_cutoffs(["2026-05-01"]))]), X.ORIGINAL)


@R.query(
    "s5_archive_round_trip",
    over(
        "raw",
        f"""SELECT source_archive, substr(source_file, 1, 4) || '.csv' AS source_file,
        CAST(1 + row_number() OVER (PARTITION BY source_archive, substr(source_file, 1, 4) ORDER BY source_row_number)
            AS BIGINT) AS source_row_number,
        {', '.join(S.RAW_COLUMNS)} FROM raw""",
    ), text=("service_date", *S.TIMESTAMPS, *S.INTEGERS),)
def _(spark, folder):
    """One archive per supplier with a file per year; read back, checked and numbered as files are."""
    path = _place(spark, "archives")
    text = archives.as_text(R.raw(spark, folder))
    year = F.concat(F.substring("source_file", 1, 4), F.lit(".csv"))
    archives.write_archives(text.withColumn("year", year), path, "source_archive", "year", "source_row_number")
    return archives.read_archives(spark, path)
