"""Streams of changes merged into record tables batch by batch, and bucketed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import upsert


def merge_stream(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge_by: list[str], checkpoint: str, order: str | None = None, strategy: str = "append") -> StreamingQuery:
    """Starts a query that upserts each batch of changes into a table.

    The checkpoint holds the offsets. A batch may come twice after a failure; upserts by key give the same again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch, merge_by, strategy, order), number)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed_counts(events: DataFrame, time: str, unit: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events by calendar bucket and keys, for batches and, with a watermark, for streams."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.date_trunc(unit, F.col(time)).alias("bucket"), *keys).agg(F.count(F.lit(1)).alias("n"))
