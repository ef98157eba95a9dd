"""Batch-at-a-time cleaning with running counters, as a stream over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lagline import schema as S
from lagline.operators import contracts as Q
from lagline.operators import events as E


def clean_arrivals(spark: SparkSession, source: str, output: str, counters: str, checkpoint: str) -> StreamingQuery:
    """Clean whatever event files have arrived since the last run, then stop.

    Each micro-batch passes the full contract before it is written under its own batch
    number; a batch that is retried after a failure overwrites itself. A bad batch stops
    the stream and writes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        Q.enforce(batch, Q.event_rules())
        clean = E.derive(batch)
        clean.write.mode("overwrite").parquet(f"{output}/batch={number}")
        Q.cleaning_counters(clean).write.mode("overwrite").json(f"{counters}/batch={number}")

    return (
        spark.readStream.schema(S.EVENT_SCHEMA)
        .parquet(source)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counters(spark: SparkSession, counters: str) -> DataFrame:
    """Totals over all batches so far."""
    table = spark.read.json(counters)
    return table.agg(*[F.sum(c).alias(c) for c in table.columns if c != "batch"])
