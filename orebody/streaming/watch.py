"""Watching a source tree.

The built-in file source reports new paths only, so a tick stream drives batches that compare a fresh listing with the
stored state; modified and deleted files are found as well. Bursts of events are one session (a trailing debounce).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orebody.operators.changes import file_changes


def debounced(events: DataFrame, time: str, keys: list[str], gap: str = "2 seconds") -> DataFrame:
    """Sessions of events less than `gap` apart: keys, first, last, events. Batch or stream (give a stream a watermark)."""
    return events.groupBy(*keys, F.session_window(time, gap)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events")).drop("session_window")


def late_tolerant(events: DataFrame, time: str, keys: list[str], gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """debounced() over a stream; events later than `lateness` are left out."""
    return debounced(events.withWatermark(time, lateness), time, keys, gap)


def watch(spark: SparkSession, listing: Callable[[], DataFrame], state_path: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "2 seconds", once: bool = False, stamps: Callable[[], DataFrame] | None = None, max_failures: int = 5) -> StreamingQuery:
    """Runs on_change(changes, batch) whenever the listing (path, content_hash) differs from the stored state.

    stamps gives path, length and modified; while those stay as they were, no file is read. A burst is waited out: work begins
    when two looks in a row see the same stamps. The state is written to a folder of its own number and then taken by its
    successor, so a failed batch leaves the last good state and the next finds the same changes again; after max_failures
    failures in a row the query fails.
    """
    from orebody.sources.store import StateStore

    store = StateStore(spark, state_path)
    seen: dict[str, object] = {"stamp": None, "done": None, "failures": 0}

    def stamp():
        row = stamps().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    def step(_: DataFrame, batch: int) -> None:
        if stamps is not None:
            now = stamp()
            settled = once or now == seen["stamp"] or seen["stamp"] is None
            seen["stamp"] = now
            if now == seen["done"] or not settled:
                return
        try:
            current = listing()
            changed = file_changes(current, store.read(current.schema)).where("status <> 'unchanged'")
            if not changed.isEmpty():
                on_change(changed, batch)
                store.write(current)
            seen["failures"], seen["done"] = 0, seen["stamp"]
        except Exception:
            seen["failures"] += 1
            if once or seen["failures"] >= max_failures:
                raise

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
