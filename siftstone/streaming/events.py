"""Streams: windows over late events, and ingest that keeps a knowledge base's tables up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.catalog import Catalog


def tumbling(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts and sums by window; the same plan for a table and for a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_up(stream: DataFrame, catalog: Catalog, checkpoint: str, tables: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]]) -> StreamingQuery:
    """Start upserting into each table what its function makes of every new batch; repeated batches change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        for name, (make, keys) in tables.items():
            catalog.upsert(name, make(batch), keys)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
