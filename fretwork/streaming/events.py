"""Event streams: duplicates, queue metrics per time window, conversation sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fretwork.operators.handoffs import queue_counts
from fretwork.streaming.files import append_stream, run_available


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row per key; a copy counts as one if it arrives within ``delay``, later keys are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_dedup(stream: DataFrame, keys: list[str], time: str, delay: str, path: str, checkpoint: str) -> None:
    append_stream(dedup(stream, keys, time, delay), path, checkpoint)


def queue_metrics(stream: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Queue counters per tumbling window; works on streams and on tables."""
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    counted = rows.groupBy(F.window(time, window).alias("w")).agg(*queue_counts())
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *counted.columns[1:])


def stream_queue_metrics(stream: DataFrame, time: str, window: str, delay: str, path: str, checkpoint: str) -> None:
    """Append each changed window with the number of its batch; readers keep the latest per window.

    A repeated batch appends the same rows again, which the latest-per-window read does not notice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    metrics = queue_metrics(stream, time, window, delay)
    run_available(metrics.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Conversation sessions: events of one key that follow each other within ``gap``.

    On a table the sessions of each key and day are made first, so that the events of a hot key spread over its days; then
    those that run over midnight are put together, from one row per piece.
    """
    if events.isStreaming:
        return _windows(events.withWatermark(time, delay), [key], time, gap)
    pieces = _windows(events.withColumn("_day", F.to_date(time)), [key, "_day"], time, gap)
    order = Window.partitionBy(key).orderBy("session_start")
    starts = F.coalesce((F.col("session_start") >= F.lag("session_end").over(order)).cast("int"), F.lit(1))
    numbered = pieces.withColumn("_first", starts).withColumn("_session", F.sum("_first").over(order))
    return numbered.groupBy(key, "_session").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("n_events").alias("n_events"), F.max("last_event").alias("last_event"),
    ).drop("_session")


def _windows(rows: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    grouped = rows.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max(time).alias("last_event")
    )
    return grouped.select(
        keys[0], F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "last_event"
    )


def stream_sessions(
    stream: DataFrame, key: str, time: str, gap: str, delay: str, path: str, checkpoint: str
) -> None:
    """Append each session once it is over, that is once the watermark has passed its end."""
    append_stream(sessions(stream, key, time, gap, delay), path, checkpoint)
