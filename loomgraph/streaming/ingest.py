"""Incremental ingestion by Structured Streaming: micro-batches become partial aggregates or keyed upserts of a table.

The sinks are idempotent: a batch writes under its own number, so that a batch that runs again after a failure replaces what
it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from loomgraph.operators.upserts import last_wins


def follow(
    spark: SparkSession, source: str, schema: StructType, state: str, each: Callable[[DataFrame, int], None], files: int = 100
) -> StreamingQuery:
    """Runs ``each`` on every micro-batch of new Parquet files under ``source`` until all that are there are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def partial_counts(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that writes the counts of each batch by ``keys``; ``combined`` adds them up."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def combined(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def keyed_versions(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key within a batch; ``latest`` takes the last over all batches."""

    def each(batch: DataFrame, number: int) -> None:
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    return last_wins(spark.read.parquet(path).drop("batch"), keys, order)


def windowed_counts(stream: DataFrame, at: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per window of event time and key; rows later than ``late`` are left out once their window is closed."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("since"), key, "n")
    )
