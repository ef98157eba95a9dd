"""Facts about Parquet tables from their footers: no row is read.

A listing gives the files; executors read one footer per file through Arrow's file systems.
Row groups without statistics give ``complete = False``, and the caller reads the column then.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

FOOTER = "file string, bytes long, rows long, row_groups long, columns string, low timestamp_ntz, high timestamp_ntz, complete boolean"
_FOOTER = pa.schema([
    ("file", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("row_groups", pa.int64()),
    ("columns", pa.string()), ("low", pa.timestamp("us")), ("high", pa.timestamp("us")), ("complete", pa.bool_()),
])


def listed_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, time in ms) of a file or of all data files below a folder, in order of name."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = system.listFiles(location, True), []
    while files.hasNext():
        file = files.next()
        if not file.getPath().getName().startswith(("_", ".")):
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return sorted(found)


def state_mark(spark: SparkSession, *paths: str) -> str:
    """A mark that changes whenever a file comes, goes or is rewritten."""
    state = hashlib.sha256()
    for path in paths:
        for row in listed_files(spark, path):
            state.update(repr(row).encode())
    return state.hexdigest()


def _footer(file: str, column: str) -> dict:
    system, place = pa.fs.FileSystem.from_uri(file if "://" in file else file.replace("file:", "file://", 1))
    with system.open_input_file(place) as stream:
        bytes_, parquet = stream.size(), pq.ParquetFile(stream)
        meta, schema = parquet.metadata, parquet.schema_arrow
        at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == column), None)
        lows, highs, complete = [], [], True
        for g in range(meta.num_row_groups if at is not None else 0):
            group = meta.row_group(g)
            part = group.column(at).statistics
            if part is not None and part.has_min_max:
                lows.append(part.min)
                highs.append(part.max)
            elif part is None or not part.has_null_count or part.null_count < group.num_rows:
                complete = False
    names = ", ".join(f"{f.name} {f.type}" for f in schema)
    whole = [pa.scalar(v).cast(pa.timestamp("us")).as_py() for v in (min(lows), max(highs))] if complete and lows else [None, None]
    return {
        "file": file, "bytes": bytes_, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": names,
        "low": whole[0], "high": whole[1], "complete": complete,
    }


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per file: size, rows, ordered columns with types, and the range of a date or time column.

    A table without files gives no row; where the column is null
    throughout or absent, there is no range, and the footer is complete without.
    """
    files = [(file,) for file, _, _ in listed_files(spark, path)]

    def read(batches):
        for batch in batches:
            rows = [_footer(file, column) for file in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOOTER)

    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return spark.createDataFrame(files, "file string").repartition(parts).mapInArrow(read, FOOTER)


def table_facts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row: files, rows, number of columns, schemas in use, and the column's range.

    Files whose footers don't tell the range are the only ones whose column is read.
    """
    facts = footers(spark, path, column)
    silent = [row.file for row in facts.where("NOT complete").select("file").collect()]
    ranges = facts.where("complete").select("low", "high")
    if silent:
        value = F.col(column).cast("timestamp_ntz")
        ranges = ranges.unionByName(spark.read.parquet(*silent).agg(F.min(value).alias("low"), F.max(value).alias("high")))
    whole = facts.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_distinct("columns").alias("schemas"),
        F.min("columns").alias("columns"),
    )
    # Both sides have exactly one row.
    return whole.withColumns({
        name: ranges.agg(rule(name).alias(name)).scalar() for name, rule in (("low", F.min), ("high", F.max))
    })
