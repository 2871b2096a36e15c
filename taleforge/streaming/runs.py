"""Resumable work as streams: checkpointed progress, and event-time counts (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_available(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Work off what is new since the last run and stop; a restart goes on after the last finished batch.

    source is a streaming table; each batch's results go to a folder named by its number, so a batch that is
    repeated after a failure replaces its own results.
    """

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type of an event stream, with a bound on lateness; ts may lack a zone and is then UTC."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
