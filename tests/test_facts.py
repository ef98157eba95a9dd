"""Exact moments, repeated rows by marks, and facts from footers."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lagline.operators import profile as P
from lagline.operators import summaries as M
from lagline.sources import footers as T

COLUMNS = "g string, on_time_performance_deviation_seconds long, on_time_performance_status string"


@pytest.mark.parametrize("offset", [0, 10**9, -(10**12)])
def test_spread_is_right_at_any_offset(spark, offset):
    values = [int(v) for v in np.random.default_rng(2).integers(-300, 900, 500)]
    rows = [("a", offset + v, "late") for v in values] + [("b", offset, None)] * 3 + [("c", offset + 5, None)]
    got = {r.g: r for r in M.summarize(spark.createDataFrame(rows, COLUMNS), ["g"]).collect()}
    assert got["a"].std_deviation_seconds == pytest.approx(np.std(values, ddof=1), rel=1e-12)
    assert got["a"].mean_deviation_seconds == pytest.approx(offset + np.mean(values), rel=1e-15)
    assert got["b"].std_deviation_seconds == 0.0 and got["c"].std_deviation_seconds is None


def plain_duplicates(rows):
    counts = {}
    for row in rows:
        counts[row] = counts.get(row, 0) + 1
    return sum(n - 1 for n in counts.values()), sum(n for n in counts.values() if n > 1)


@pytest.mark.parametrize("limit", [0, P.BROADCAST_MARKS])
def test_repeated_rows_with_equal_hashes(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_MARKS", limit)
    rows = [(None, "1", 0.5), ("1", None, 0.5), (None, "1", 0.5), ("x", "y", None), ("hot", "hot", 1.0)] + [("hot", "hot", 1.0)] * 40
    rows += [(str(i), "z", float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "a string, b string, c double").repartition(5)
    twins = lambda df, columns: [F.lit(1).cast("long"), (F.length("b") % 2).cast("long")]
    for marks in (P.row_marks, twins):
        assert tuple(P.duplicates(table, ["a", "b", "c"], marks).first()) == plain_duplicates(rows)
    assert tuple(P.duplicates(table.limit(0), ["a", "b", "c"]).first()) == (0, 0)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "c double")
    assert tuple(P.duplicates(zeros, ["c"]).first()) == (1, 2)


def test_duplicates_send_marks_only(spark):
    table = spark.range(5000).select("id", F.repeat(F.col("id").cast("string"), 50).alias("wide"))
    marks = table.select(*[m.alias(f"h{i}") for i, m in enumerate(P.row_marks(table, ["id", "wide"]))])
    assert marks.distinct().count() == 5000


def write(path, days, statistics=True, name="d"):
    pq.write_table(pa.table({name: pa.array(days, pa.date32()), "n": list(range(len(days)))}), path, write_statistics=statistics, row_group_size=2)


def test_facts_equal_the_rows(spark, tmp_path):
    day = dt.date(2024, 1, 5)
    days = [[day, None, dt.date(2023, 2, 1)], [None, None], [dt.date(2025, 6, 7), day, day]]
    for i, part in enumerate(days):
        write(f"{tmp_path}/part-{i}.parquet", part, statistics=i != 2)
    (tmp_path / "_SUCCESS").touch()
    got = T.table_facts(spark, str(tmp_path), "d").first()
    assert (got.files, got.rows, got.schemas) == (3, 8, 1) and got.columns == "d date32[day], n int64"
    assert (got.low, got.high) == (dt.datetime(2023, 2, 1), dt.datetime(2025, 6, 7))
    complete = {r.file[-9:]: r.complete for r in T.footers(spark, str(tmp_path), "d").collect()}
    assert complete == {"0.parquet": True, "1.parquet": True, "2.parquet": False}


def test_facts_read_no_rows_and_tell_schemas_apart(spark, tmp_path):
    write(f"{tmp_path}/a.parquet", [dt.date(2024, 1, 5)])
    plan = T.footers(spark, str(tmp_path), "d")._jdf.queryExecution().toString()
    assert "FileScan" not in plan
    write(f"{tmp_path}/b.parquet", [dt.date(2024, 1, 5)], name="e")
    facts = T.table_facts(spark, str(tmp_path), "d").first()
    assert (facts.schemas, facts.low, facts.high) == (2, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5))
    assert {r.columns for r in T.footers(spark, str(tmp_path), "d").collect()} == {"d date32[day], n int64", "e date32[day], n int64"}


def test_mark_follows_the_files(spark, tmp_path):
    write(f"{tmp_path}/a.parquet", [dt.date(2024, 1, 5)])
    first = T.state_mark(spark, str(tmp_path))
    assert first == T.state_mark(spark, str(tmp_path))
    write(f"{tmp_path}/b.parquet", [dt.date(2024, 1, 5)])
    assert T.state_mark(spark, str(tmp_path)) != first
