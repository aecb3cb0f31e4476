"""Schedules as a stream: new files are read as they arrive and go through the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_arrivals(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Handles every Parquet file under `source` once: each micro-batch passes through `step` and is appended to `target`.

    The batch number names the output folder, which is overwritten when a batch
    is repeated after a failure; so each file's rows land exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
