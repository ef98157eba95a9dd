"""Parquet tables: staged writes that are checked before they replace anything."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.operators.contracts import ContractError, require_columns, split_rules, enforce


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_checked(
    df: DataFrame,
    path: str,
    expected_rows: int | None = None,
    partition_by: Sequence[str] = (),
) -> int:
    """Write beside the target, read back, compare rows and columns, then swap.

    A failure at any point leaves the old table in place and removes the staged files.
    """
    spark = df.sparkSession
    system, Path = _filesystem(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    target, staging, retired = Path(path), Path(staged), Path(f"{path}.retired-{uuid.uuid4().hex}")
    try:
        df.write.partitionBy(*partition_by).option("compression", "snappy").parquet(staged)
        back = spark.read.schema(df.schema).parquet(staged)
        # Partition columns live in folder names, which have no type of their own.
        typed = lambda schema: [(f.name, None if f.name in partition_by else f.dataType) for f in schema]
        found, wanted = typed(spark.read.parquet(staged).schema), typed(df.schema)
        if sorted(map(str, found)) != sorted(map(str, wanted)):
            raise ContractError({"written_columns": 1}, [{"expected": wanted, "found": found}])
        rows = back.count()
        if rows == 0:
            raise ContractError({"no_rows": 1})
        if expected_rows is not None and rows != expected_rows:
            raise ContractError({"written_rows": 1}, [{"expected": expected_rows, "found": rows}])
        replaces = system.exists(target)
        if replaces and not system.rename(target, retired):
            raise OSError(f"cannot retire {path}")
        if not system.rename(staging, target):
            if replaces:
                system.rename(retired, target)
            raise OSError(f"cannot place {path}")
        if replaces:
            system.delete(retired, True)
        return rows
    except Exception:
        if system.exists(staging):
            system.delete(staging, True)
        raise


def load_split(spark: SparkSession, path: str, split: str, target: str = S.TARGET) -> DataFrame:
    """One chronological split of a feature table; empty or unlabelled is an error."""
    table = spark.read.parquet(path)
    require_columns(table, [*S.CONTEXT, *S.PREDICTORS, target])
    rows = table.where(F.col("data_split") == split)
    enforce(rows, split_rules(target))
    return rows


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count and sums over two row hashes."""
    columns = [F.col(c) for c in df.columns]
    first = F.xxhash64(*columns).cast("decimal(38,0)")
    second = F.hash(*columns).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(first).cast("string").alias("sum64"), F.sum(second).alias("sum32")
    )


def cached_table(source: DataFrame, path: str, build, settings: str = "") -> DataFrame:
    """A derived table, rebuilt unless it was made from this source under these settings.

    The mark is part of the path that is read, so a crash between writing the table and
    recording it leaves a table that nobody reads.
    """
    spark = source.sparkSession
    system, Path = _filesystem(spark, path)
    now = fingerprint(source).first()
    mark = hashlib.sha256(repr((tuple(now), settings)).encode()).hexdigest()[:32]
    current = f"{path}/made-from-{mark}"
    if not system.exists(Path(current)):
        write_checked(build(source), current)
        for other in system.listStatus(Path(path)):
            if other.getPath().getName() != f"made-from-{mark}":
                system.delete(other.getPath(), True)
    return spark.read.parquet(current)
