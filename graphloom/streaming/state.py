"""Stateful operators: limits anchored at a key's first request, and their streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_window_limit(requests: DataFrame, key: str, at: str, ids: str, limit: int, seconds: int) -> DataFrame:
    """ids and allowed.  A key's window starts with its first request and lasts `seconds`; then the next request opens
    another.  The chain of windows depends on each request before, so a key is walked in time order; rows of a key
    arrive sorted in batches and only the open window is kept."""
    kinds = dict(requests.dtypes)
    width = pd.Timedelta(seconds=seconds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, start, n = object(), None, 0
        for d in frames:
            allowed = []
            for k, t in zip(d[key], d[at], strict=True):
                if k != own or t - start >= width:
                    own, start, n = k, t, 0
                n += 1
                allowed.append(limit <= 0 or n <= limit)
            yield pd.DataFrame({ids: d[ids], "allowed": allowed})

    return requests.select(key, at, ids).repartition(key).sortWithinPartitions(key, at, ids).mapInPandas(run, f"{ids} {kinds[ids]}, allowed boolean")


def retry_after(open_windows: DataFrame, start: str, now: str, seconds: int) -> DataFrame:
    """Whole seconds until each window ends, between 0 and 60."""
    left = F.lit(seconds) - F.floor(F.col(now).cast("double") - F.col(start).cast("double"))
    return open_windows.withColumn("retry_after", F.greatest(F.lit(0), F.least(F.lit(60), left)).cast("int"))


def stream_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per event type and time window over a stream (or a table), with late data admitted for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


def stream_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions per user that end after `gap` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def stream_upsert(source: DataFrame, write, checkpoint: str):
    """Each micro-batch of a stream handed to write(batch, id) once, in order; returns the running query."""
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
