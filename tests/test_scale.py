"""What keeps the jobs fast and small at size: compiled code, tasks enough."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import SMALL

from lagline import catalog
from lagline.functions import columns as C
from lagline.operators import contracts, events as E
from lagline.operators import fallback as B
from lagline.sources import archives
from lagline.sources.lineitem import raw_events

COMPILED = 8000  # bytes of a method that the JVM still compiles
LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp_ntz"


def largest_method(df) -> int:
    told = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", told)))


def test_feature_rows_come_from_methods_the_jvm_compiles(spark, tmp_path):
    spark.range(1000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "int(id % 7 + 1) AS l_linenumber",
        "CAST(date_add(DATE'1995-01-01', int(id)) AS TIMESTAMP_NTZ) AS l_shipdate",
    ).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = E.with_day_keys(E.regression_features(E.derive(raw_events(spark, str(tmp_path)))))
    assert largest_method(rows.withColumn("service_month", C.month_start(F.col("service_date")))) < COMPILED


def test_the_peak_offset_follows_the_scheduled_minute(spark, tmp_path):
    rows = [(ok, 1, 1, ln, None) for ok in range(1200) for ln in (1, 2)] + [(None, 1, 1, 1, None), (-7, 1, 1, 1, None), (3, None, None, 1, None)]
    spark.createDataFrame(rows, LINES).withColumn("l_shipdate", F.expr("TIMESTAMP_NTZ'1995-03-04 00:00:00'")).write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    found = raw_events(spark, str(tmp_path)).where("vehicle_id = 'v1' AND on_time_performance_deviation_seconds IS NOT NULL")
    found = found.selectExpr(
        "source_row_number div 10000000 AS ok", "stop_sequence AS ln",
        "hour(scheduled_departure_time) AS hour", "on_time_performance_deviation_seconds AS deviation",
    ).collect()
    assert sum(r.hour == 15 for r in found) > 0
    for r in found:
        if r.ok >= 0:
            plain = (31 + r.ok * 17 + r.ln * 7) % 541 - 150 + 60  # route 1
            assert r.deviation == plain + (45 if r.hour == 15 else 0)


def test_archives_are_dealt_to_many_tasks(spark, tmp_path):
    names = spark.range(60).selectExpr("concat('a', id) AS archive", "concat('/tmp/none/a', id) AS path", "'x.csv' AS member")
    parts = archives._by_member(names).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert parts > 1
    text = raw_text(spark)
    archives.write_archives(text, f"{tmp_path}/zips", "source_archive", "source_file", "source_row_number")
    checked = archives.inspect(archives.list_archives(spark, f"{tmp_path}/zips")).withColumn("task", F.spark_partition_id())
    assert checked.count() == 40
    assert checked.select("task").distinct().count() > 1


def test_small_members_keep_their_rows_and_numbers(spark, tmp_path):
    archives.write_archives(raw_text(spark), f"{tmp_path}/zips", "source_archive", "source_file", "source_row_number")
    found = archives.text_records(archives.inspect(archives.list_archives(spark, f"{tmp_path}/zips"))).collect()
    assert sorted((r.source_archive, r.source_row_number, r.trip_id) for r in found) == sorted(
        (f"a{i % 40}.zip", 2 + i // 40, f"t{i}") for i in range(120)
    )


def raw_text(spark):
    from lagline import schema as S

    given = {"trip_id": "concat('t', id)"}
    return spark.range(120).selectExpr(
        "concat('a', id % 40, '.zip') AS source_archive", "'x.csv' AS source_file", "id AS source_row_number",
        *[f"{given.get(c, repr(c))} AS {c}" for c in S.RAW_COLUMNS],
    )


def test_counts_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "COUNTS_OF_TASK", 100)
    counts = spark.range(2500)
    assert B._tasks(counts) == 25
    assert B._tasks(spark.range(0)) == spark.sparkContext.defaultParallelism


def test_unseen_hours_meet_distinct_hours(spark):
    """The events are grouped by hour before the join, not joined one by one."""
    plan = catalog.queries()["u2_unseen_hours"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftAnti") :]
    assert join.count("Aggregate [scheduled_hour") >= 1


def test_changed_rows_count_as_a_multiset(spark):
    """Rows travel as hashes; nulls, repeats, wider types and the sign of zero are no changes."""
    before = spark.createDataFrame([(1, "a", 0.0), (1, "a", 0.0), (2, None, None), (3, "c", 1.0), (3, "c", 1.0)], "n int, s string, x double")
    after = spark.createDataFrame([(1, "a", -0.0), (1, "a", 0.0), (2, None, None), (3, "c", 1.0), (None, "c", 1.0)], "n long, s string, x double")
    columns = ["n", "s", "x"]
    assert contracts.changed_rows(before, after, columns).first().rows_changed == 2
    assert contracts.changed_rows(before, before, columns).first().rows_changed == 0
    assert contracts.changed_rows(before.limit(0), before.limit(0), columns).first().rows_changed == 0
    assert contracts.changed_rows(before, after.limit(0), columns, lambda *_: [F.lit(1), F.lit(2)]).first().rows_changed == 5


def test_examples_come_from_the_first_rows(spark, monkeypatch):
    """First values by provenance from bounded heads of rows, with ties, nulls and late values."""
    from lagline.operators import profile as P

    rows = [("a", "f", i // 3, "same", None if i < 40 else str(i % 2), f"x{(i * 7) % 5}", "late" if i == 59 else None, None) for i in range(60)]
    rows += [(None, "f", 9, "same", None, "null place", None, None)]
    names = ["p", "q", "r", "s", "t"]
    df = spark.createDataFrame(rows, "source_archive string, source_file string, source_row_number long, " + ", ".join(f"{n} string" for n in names))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[:3]))
    want = {}
    for i, n in enumerate(names, 3):
        first = {}
        for at, r in enumerate(ordered):
            if r[i] is not None:
                first.setdefault(r[i], (r[0] is not None, r[2]))
        want[n] = " | ".join(sorted(first, key=lambda v: (first[v], v))[:3])
    for head in (1000, 7, 2):  # whole, cut, and fewer rows than a place has
        monkeypatch.setattr(P, "HEAD", head)
        assert {r[0]: r[1] for r in P.first_values(df.repartition(4), names).collect()} == want
    jobs = spark.sparkContext.statusTracker()
    monkeypatch.setattr(P, "HEAD", 1000)
    spark.sparkContext.setJobGroup("examples", "examples")
    P.first_values(df.repartition(4), ["r"])
    assert len(jobs.getJobIdsForGroup("examples")) <= 2  # three rounds over all rows before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_folders_are_written_without_sorting_the_rows(spark, monkeypatch):
    """A task keeps a file per folder open; rows of further folders are written as well."""
    from pyspark.sql import DataFrameWriter

    from lagline.sources import work

    setting, held, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (held.append(int(spark.conf.get(setting))), write(self, path))[1])
    rows = spark.range(1000).selectExpr("id", "IF(id % 21 = 20, NULL, id % 21) AS folder")
    for folders in (work.OPEN_FILES, 2):
        monkeypatch.setattr(work, "OPEN_FILES", folders)
        back = work.materialize(rows, "folders", ["folder"])
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert held == [16, 2] and spark.conf.get(setting) == "0"
