"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lagline.session import run_folder

OPEN_FILES = 16  # folders a task writes to at once; with more, it sorts the rest of its rows by folder
GROUP_BYTES = 32 << 20  # of a row group, which each open file holds in memory


@contextmanager
def _open_files(spark: SparkSession) -> Iterator[None]:
    """Let tasks keep a file per folder open instead of sorting all of their rows by folder first."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write once, read back: later steps start from files, not from the lineage.

    Several consumers then share one computation, a lost executor costs only its running
    tasks, and the planner sees real sizes when it decides about broadcasts.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if partition_by:
        with _open_files(spark):
            df.write.partitionBy(*partition_by).option("parquet.block.size", GROUP_BYTES).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan reads any more.

    A folder goes as a whole; what lies outside this application's folder is left alone.
    """
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            base, _, rest = file.partition(f"/{run_folder(spark).rsplit('/', 1)[1]}/")
            if rest:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{run_folder(spark)}/{rest.split('/', 1)[0]}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of very few splits, such as one small file.

    An input with at least as many splits as cores, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
