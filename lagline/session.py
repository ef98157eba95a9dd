"""Session settings the jobs in this package rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Adaptive execution does the run-time sizing: it coalesces shuffle partitions, splits skewed
# join partitions, and switches to a broadcast join only after measuring the built side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str | None = None
) -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lagline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def use_checkpoints(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, made known to the context.

    It is the one the session or the context names. Only where neither does, a session on this
    machine alone gets a temporary folder, deleted when the process ends; on a cluster the
    setting has to be there, because a lost executor takes its local disk with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = _local_folders.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lagline-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{use_checkpoints(spark)}/lagline-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; for the end of a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
