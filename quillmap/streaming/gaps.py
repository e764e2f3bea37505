"""Gap clustering of an event stream: sessions per key that close when the watermark passes their gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, value_sum) of runs of events at most `gap` apart, for batch and streaming frames alike.

    Events exactly a gap apart belong together. On a stream, state is dropped and later events ignored once the
    watermark, `late` behind the latest event, is past a session's end.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value_sum")


def tumbling_counts(events: DataFrame, keys: Sequence[str], time: str, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    out = events.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")
