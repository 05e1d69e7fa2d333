"""Streaming twins of the batch reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_state_stream(events: DataFrame) -> DataFrame:
    """The state of each job so far (job_id, status, updated_at), for the update or complete mode; a terminal state is never left."""
    rank = F.struct(F.col("status").isin("succeeded", "failed").cast("int").alias("t"), F.col("ts"), F.col("seq"))
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), rank).alias("s"))
    return last.select("job_id", F.col("s.status").alias("status"), F.col("s.ts").alias("updated_at"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete"):
    """Run a stream over what is there now, into a table in memory; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
