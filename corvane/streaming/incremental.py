"""Incremental work as streams: skip what is done, merge what arrives, windows over events.

The reference works by batches that skip what exists; these are the same behaviours for files that keep arriving.
Windows and sessions go beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import sinks


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet: resume without paging through a set that shrinks."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def read_arrivals(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order=None, available_now: bool = True, partition_by: list[str] | None = None) -> StreamingQuery:
    """Merge a stream into a folder by key; a batch that is run again merges the same rows, so the result stays.

    With ``partition_by``, columns of the key, a batch rewrites only the partitions its rows fall into.
    """

    def merge(batch: DataFrame, _: int) -> None:
        sinks.upsert(batch.sparkSession, path, batch, keys, order, partition_by)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """A stream without repeated keys among what arrives within ``late`` of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, time: str, width: str, by: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """``(window_start, window_end, by…, n)`` of events, on a stream or a table."""
    df = df.withWatermark(time, late) if late else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """``(by…, session_start, session_end, n)`` of events with less than ``gap`` between them."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(*by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def running_counts(stream: DataFrame, key: str, timeout_ms: int | None = None) -> DataFrame:
    """``(key, total)`` of a keyed stream of rows, kept as state between batches.

    With ``timeout_ms`` a key idle that long is forgotten; such a stream looks for idle keys as long as it runs, so it
    doesn't end by itself.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def add(k: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "total": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, total long", "n long", "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def watch_progress(query: StreamingQuery, tell: Callable[[dict], None]) -> None:
    """Tell each batch's progress until the stream ends."""
    seen = -1
    while query.isActive:
        p = query.lastProgress
        if p and p["batchId"] != seen:
            seen = p["batchId"]
            tell({"batch": seen, "rows": p["numInputRows"]})
        query.awaitTermination(1)
