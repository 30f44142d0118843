"""A trailing debounce of a stream as keyed state: bursts of events come out once they have been quiet for long enough.

Bursts are Spark's session windows: its state holds each key's open ones, new events are merged into them, whatever order they
come in, and a burst comes out when the watermark passes its last event by the gap. The state lies in the query's checkpoint,
so a driver that starts again goes on where the last one was. Events whose own quiet time ended before the watermark are left
out; one that is in time can never belong to a burst that has come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(bursts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Bursts (first, last, events) that are less than `gap` apart are one: what the windows give, for a list."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(bursts):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def debounced_stream(events: DataFrame, time: str, key: str, gap_seconds: float, lateness: str = "10 seconds") -> DataFrame:
    """events: a stream. key, first, last (microseconds) and events of each burst that has been quiet for the gap. What
    batch sessions of the same events give, once the watermark has passed them."""
    gap = f"{round(gap_seconds * 1_000_000)} microseconds"
    rows = events.withWatermark(time, lateness).select(F.col(key).alias("key"), time, F.unix_micros(time).alias("us"))
    bursts = rows.groupBy("key", F.session_window(time, gap)).agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("events"))
    return bursts.select(F.col("key").alias(key), "first", "last", "events")
