"""Structured Streaming: triples in micro-batches, running state, checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.triples import aggregate, with_ids


def stream_triples(source: DataFrame, to_triples: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch's triples are written under its own number, so a batch that is tried
    again replaces itself; offsets and recovery are Spark's."""

    def write(batch: DataFrame, number: int) -> None:
        rows = to_triples(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def accumulated(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def edges_so_far(spark: SparkSession, out: str) -> DataFrame:
    return aggregate(with_ids(accumulated(spark, out)))


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts and sums by type; rows later than the watermark allows are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stream_windows(source: DataFrame, out: str, checkpoint: str, late: str = "1 hour", width: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Windows that a micro-batch changes are written under its number; state is dropped behind the watermark."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = event_windows(source, late, width).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windows_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Each window as the latest micro-batch left it."""
    last = F.max_by(F.struct("n", "total"), "batch").alias("w")
    return accumulated(spark, out).groupBy("start", "event_type").agg(last).select("start", "event_type", "w.*")
