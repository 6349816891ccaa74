"""Runs that go on where they stopped, as a stream over a folder with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def resume(spark: SparkSession, source: str, schema: str, done: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Apply `work` to the source's files that no earlier run has finished, and append the result; the checkpoint knows which."""
    stream = spark.readStream.schema(schema).parquet(source)
    work(stream).writeStream.format("parquet").option("path", done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
