"""Archives, CSV, staged writes, caches, the build from files to features, the stream."""

from __future__ import annotations

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from lagline import schema as S
from lagline.operators import events as E
from lagline.operators.contracts import ContractError
from lagline.plans import build
from lagline.sources import archives, reports, tables
from lagline.streaming import incremental

HEADER = ",".join(S.RAW_COLUMNS)
GOOD = (
    "1/5/2026,Example Transit,1,Inbound,1.3E+11,v1,A,Main St,1,,2026-01-05T06:30:00.000Z,,2026-01-05T06:31:00.000Z,60,60,On Time\n"
    "1/5/2026,Example Transit,1,NA,1.3E+11,v1,A,Main St,2,2026-01-06T00:10:00.000Z,,2026-01-06T00:06:00.000Z,,,-240,Very Early\n"
    "1/5/2026,Example Transit,1,Outbound,1.3E+11,v1,B,null,3,,2026-01-05T07:00:00.000Z,,,,,\n"
)


def pack(folder, name, members):
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in members.items():
            z.writestr(member, text)
    return folder


def test_archives_to_features(spark, tmp_path):
    raw = pack(tmp_path / "in", "b.ZIP", {"x/one.csv": "﻿" + HEADER + "\n" + GOOD, "readme.txt": "no"})
    pack(raw, "A.zip", {"two.CSV": HEADER + "\n" + GOOD})
    events = build.ingest(spark, str(raw), str(tmp_path / "events"), str(tmp_path / "manifest"))
    assert events.columns == S.PROVENANCE + S.RAW_COLUMNS
    rows = events.orderBy("source_archive", "source_row_number").collect()
    assert [(r["source_archive"], r["source_file"], r["source_row_number"]) for r in rows[:3]] == [("A.zip", "two.CSV", n) for n in (2, 3, 4)]
    assert rows[3]["source_file"] == "one.csv" and rows[1]["direction_code"] is None and rows[2]["stop_name"] is None
    manifest = spark.read.json(str(tmp_path / "manifest"))
    assert manifest.where("source_archive = '*'").first()["rows"] == 6

    clean = build.clean(spark, str(tmp_path / "events"), str(tmp_path / "clean"), str(tmp_path / "cleaning"))
    assert clean.columns == S.CLEAN_SCHEMA.names and clean.count() == 6
    assert clean.where("is_after_midnight_service").count() == 2
    numeric, labelled = build.features(
        spark, str(tmp_path / "clean"), str(tmp_path / "reg"), str(tmp_path / "cls"), str(tmp_path / "report")
    )
    assert (numeric.count(), labelled.count()) == (2, 2)
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    listed = archives.list_archives(spark, str(raw)).collect()
    assert [r["archive"] for r in listed] == ["A.zip", "b.ZIP"]
    import hashlib

    sums = {r["file"]: r["sha256"] for r in archives.checksums(spark, str(raw), "A.zip").collect()}
    assert sums == {"A.zip": hashlib.sha256((raw / "A.zip").read_bytes()).hexdigest()}


BAD_FILES = {
    "header": {"a.csv": HEADER.replace("service_date,transit_system_name", "transit_system_name,service_date") + "\n" + GOOD},
    "no csv": {"a.txt": "x"},
    "nothing": {},
}


@pytest.mark.parametrize("kind", BAD_FILES)
def test_unfit_archives_are_refused(spark, tmp_path, kind):
    folder = pack(tmp_path / "in", "a.zip", BAD_FILES[kind])
    with pytest.raises(ContractError):
        archives.read_archives(spark, str(folder))


def test_corrupt_archive_is_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.csv", HEADER + "\n" + GOOD)
    data = bytearray((folder / "a.zip").read_bytes())
    at = data.find(b"Main St")
    data[at : at + 4] = b"Maim"
    (folder / "a.zip").write_bytes(bytes(data))
    with pytest.raises(ContractError):
        archives.read_archives(spark, str(folder))


@pytest.mark.parametrize(
    "before, after, column",
    [
        ("1/5/2026,", "2026-01-05,", "service_date"),
        ("T06:30:00.000Z", "T06:30:00Z", "scheduled_departure_time"),
        (",60,60,", ",60.5,60,", "delay_on_departure_seconds"),
    ],
)
def test_unreadable_values_name_their_rows(spark, tmp_path, before, after, column):
    folder = pack(tmp_path / "in", "a.zip", {"a.csv": HEADER + "\n" + GOOD.replace(before, after, 1)})
    with pytest.raises(ContractError) as error:
        archives.read_archives(spark, str(folder))
    assert error.value.violations == {column: 1}
    assert error.value.samples[0]["rows"] == [2]


def test_long_rows_are_refused(spark, tmp_path):
    folder = pack(tmp_path / "in", "a.zip", {"a.csv": HEADER + "\n" + GOOD + GOOD.splitlines()[0] + ",extra\n"})
    with pytest.raises(Exception, match="Expected 16 fields"):
        archives.read_archives(spark, str(folder)).count()


def test_plain_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + GOOD)
    events = archives.read_csv_folder(spark, str(tmp_path))
    assert [r[0] for r in events.select("source_row_number").orderBy("source_row_number").collect()] == [2, 3, 4]


def test_failed_write_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.write_checked(spark.range(5), path) == 5
    with pytest.raises(ContractError):
        tables.write_checked(spark.range(3), path, expected_rows=4)
    with pytest.raises(ContractError):
        tables.write_checked(spark.range(0), path)
    assert spark.read.parquet(path).count() == 5
    assert tables.write_checked(spark.range(7), path) == 7
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_partitioned_write(spark, tmp_path):
    df = spark.range(10).withColumn("month", F.lit("2026-03-01").cast("date"))
    assert tables.write_checked(df, str(tmp_path / "t"), partition_by=["month"]) == 10


def test_load_split_guards(spark, raw, tmp_path):
    path = str(tmp_path / "f")
    tables.write_checked(E.regression_features(E.derive(raw)), path)
    assert tables.load_split(spark, path, "validation").count() == 915
    with pytest.raises(ContractError):
        tables.load_split(spark, path, "nothing")


def test_cache_follows_its_source(spark, tmp_path):
    path, runs = str(tmp_path / "c"), []

    def double(df):
        runs.append(1)
        return df.select((F.col("id") * 2).alias("id"))

    for n, builds in ((4, 1), (4, 1), (5, 2)):
        assert tables.cached_table(spark.range(n), path, double).count() == n
        assert len(runs) == builds


def test_summary_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5)], "route_name string, mae double")
    reports.write_summary_csv(df, str(tmp_path / "s"))
    assert reports.read_summary_csv(spark, str(tmp_path / "s"), df.schema).collect() == df.collect()
    nested = df.select(F.struct("*").alias("r"))
    reports.write_report(nested, str(tmp_path / "j"))
    assert reports.read_report(spark, str(tmp_path / "j"), nested.schema).collect() == nested.collect()


def test_stream_equals_batch(spark, raw, tmp_path):
    source, out, counters, mark = (str(tmp_path / n) for n in ("in", "out", "counters", "mark"))
    halves = [raw.where("stop_sequence <= 3"), raw.where("stop_sequence > 3")]
    for half in halves:
        half.write.mode("append").parquet(source)
        incremental.clean_arrivals(spark, source, out, counters, mark).awaitTermination()
    whole = E.derive(raw)
    streamed = spark.read.parquet(out).select(*whole.columns)
    assert streamed.exceptAll(whole).count() == 0 and streamed.count() == whole.count()
    totals = incremental.running_counters(spark, counters).first()
    assert totals["arrival_events"] + totals["departure_events"] == 6000


@pytest.mark.parametrize("name", ["a+b.zip", "g%h.zip", "e f.zip", "100%25 é.zip"])
def test_archive_names_are_kept_as_they_are(spark, tmp_path, name):
    folder = pack(tmp_path / "in put", name, {"a.csv": HEADER + "\n" + GOOD})
    events = archives.read_archives(spark, str(folder))
    assert {r[0] for r in events.select("source_archive").collect()} == {name}
    sums = archives.checksums(spark, str(folder)).collect()
    assert [(r["file"], r["bytes"], r["sha256"]) for r in sums] == [
        (name, (folder / name).stat().st_size, hashlib.sha256((folder / name).read_bytes()).hexdigest())
    ]


def test_one_base_name_twice_in_an_archive_is_refused(spark, tmp_path):
    text = HEADER + "\n" + GOOD
    folder = pack(tmp_path / "in", "a.zip", {"x/one.csv": text, "y/one.csv": text})
    with pytest.raises(ContractError) as error:
        archives.read_archives(spark, str(folder))
    assert error.value.violations == {"repeated_file_names": 1}


def test_every_unfit_file_is_counted(spark, tmp_path):
    for i in range(archives.SHOWN + 5):
        pack(tmp_path / "in", f"a{i}.zip", {"a.csv": "wrong,header\n1,2\n"})
    with pytest.raises(ContractError) as error:
        archives.read_archives(spark, str(tmp_path / "in"))
    assert error.value.violations == {"unfit_files": archives.SHOWN + 5}
    assert len(error.value.samples) == archives.SHOWN


def test_written_archives_read_the_same(spark, tmp_path, raw):
    folder = str(tmp_path / "made")
    some = raw.where("source_row_number % 7 = 0").withColumn("route_name", F.lit('a "quoted",\nbroken, ü'))
    text = archives.as_text(some).withColumn("day", F.col("source_file"))
    for _ in range(2):  # a second writing replaces the first
        made = archives.write_archives(text, folder, "source_archive", "day", "source_row_number")
    assert made.agg(F.sum("rows")).first()[0] == some.count()
    assert not list((tmp_path / "made").glob("*.part"))
    got = archives.read_archives(spark, folder)
    columns = ["source_archive", "source_file", *S.RAW_COLUMNS]
    assert got.select(columns).exceptAll(some.select(columns)).count() == 0
    assert some.select(columns).exceptAll(got.select(columns)).count() == 0
    assert got.agg(F.min("source_row_number")).first()[0] == 2
    with pytest.raises(Exception, match="without a name"):
        archives.write_archives(text.withColumn("day", F.lit(None).cast("string")), folder, "source_archive", "day", "source_row_number")


def test_a_small_archive_is_opened_once_a_pass(tmp_path, monkeypatch):
    """Checking and reading its members; regular ones take no pandas."""
    import pandas as pd
    import pyarrow as pa

    members = {f"{i}.csv": HEADER + "\n" + GOOD for i in range(5)}
    path, opens, plain = f"file:{pack(tmp_path / 'in', 'a.zip', members)}/a.zip", [], archives._open
    monkeypatch.setattr(archives, "_open", lambda p: opens.append(p) or plain(p))
    found = next(archives._inspect(iter([pd.DataFrame({"path": [path], "archive": ["a.zip"]})])))
    assert found["small"].all() and len(found) == 5
    opens.clear()
    assert next(archives._check(iter([found])))["problem"].isna().all() and len(opens) == 1
    monkeypatch.setattr(pd, "read_csv", None)
    batch = pa.RecordBatch.from_pandas(found[["archive", "path", "member", "bytes"]], preserve_index=False)
    rows = pa.Table.from_batches(archives._records(iter([batch])))
    assert len(opens) == 2 and rows.num_rows == 15 and rows.column_names == S.PROVENANCE + S.RAW_COLUMNS
    assert rows["source_row_number"].to_pylist() == [2, 3, 4] * 5 and rows["stop_name"].to_pylist()[2] == "null"


def test_lines_are_those_of_the_csv_writer():
    import csv
    import io

    import pyarrow as pa

    rows = [("a", "1.50", ""), ('say "x"', "p,q", "ü"), ("two\nlines", "", "\r"), (None, " pad ", "'"), ("plain", "b", "c")]
    for some in (rows, rows[-1:]):
        out = io.StringIO()
        csv.writer(out).writerows(some)
        assert "".join(archives._lines([pa.array(c, pa.string()) for c in zip(*some)]).to_pylist()) == out.getvalue()


@pytest.mark.parametrize("large", [False, True])
def test_irregular_members_read_as_before(spark, tmp_path, large):
    """Short rows are filled, blank lines skipped, line breaks in quotes kept, an open quote is refused."""
    short = GOOD.splitlines()[0].rsplit(",", 1)[0]
    text = f'﻿{HEADER}\r\n{short}\n\n{GOOD}{GOOD.splitlines()[0].replace("Main St", chr(34) + "Main" + chr(10) + "St" + chr(34))}'
    folder = pack(tmp_path / "in", "a.zip", {"a.csv": text})
    members = archives.inspect(archives.list_archives(spark, str(folder))).withColumn("bytes", F.col("bytes") + large * archives.WHOLE_BYTES)
    rows = archives.text_records(members).orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in rows] == [2, 3, 4, 5, 6]
    assert (rows[0]["on_time_performance_status"] or "") == "" and rows[4]["stop_name"] == "Main\nSt" and rows[1]["service_date"] == "1/5/2026"
    pack(tmp_path / "in", "a.zip", {"a.csv": HEADER + "\n" + GOOD.replace("Main St", '"Main St', 1)})
    with pytest.raises(Exception, match="EOF inside string"):
        archives.read_archives(spark, str(folder)).count()
