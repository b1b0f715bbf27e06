"""Streams that keep a keyed table up to date: transcripts and the handoff lifecycle."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fretwork.operators.transcripts import latest_transcripts
from fretwork.sources.keyed import latest
from fretwork.streaming.files import run_available

LIFECYCLE = "handoff_id {kind}, status string, claimed_by string, created_at timestamp, claimed_at timestamp, closed_at timestamp, final boolean"
# What is kept of a handoff: its legal moves that the watermark has passed, and the moves that it has not.
SETTLED = ", ".join(f"{step}_at long, {step}_seq long, {step}_by string" for step in ("created", "claimed", "closed"))
MOVES = "event_at long, seq long, se string, event string"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_transcripts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append transcript pages (session_id, page_no, messages, updated_at); the last save of a session replaces it whole.

    Pages of one save carry the same time and may come in different batches. Read with ``read_transcripts``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, ["session_id", "page_no"], ["updated_at"])
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    run_available(stream.writeStream.foreachBatch(write), checkpoint)


def read_transcripts(table: DataFrame) -> DataFrame:
    """Pages of the newest save per session; at equal times the later batch wins, page by page."""
    return latest_transcripts(table, "updated_at", "batch_id").drop("batch_id")


def apply_moves(settled: list, moves: list) -> list:
    """[created, claimed, closed] after further moves (time, seq, se, event); only legal moves count."""
    created, claimed, closed = settled
    for at, seq, se, event in sorted(moves, key=lambda m: (m[0], m[1])):
        if event == "create" and created is None:
            created = [at, seq, se]
        elif event == "claim" and created is not None and claimed is None:
            claimed = [at, seq, se]
        elif event == "close" and claimed is not None and closed is None and se == claimed[2]:
            closed = [at, seq, se]
    return [created, claimed, closed]


class Lifecycle(StatefulProcessor):
    """State of the open handoffs. Moves are kept until the watermark has passed them, so their order of arrival is no matter.

    A handoff whose closing the watermark has passed gives one last row, marked final, and leaves the state; one whose moves
    turn out to be illegal leaves it without a row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.moves = handle.getListState("moves", MOVES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            times = frame["event_at"].astype("datetime64[us]").astype("int64")
            new += zip(times.tolist(), frame["seq"].tolist(), frame["se"].tolist(), frame["event"].tolist(), strict=True)
        yield from self._fold(key, new, timerValues.getCurrentWatermarkInMs() * 1000, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, [], timerValues.getCurrentWatermarkInMs() * 1000, False)

    def close(self) -> None:
        pass

    def _fold(self, key, new: list, passed: int, changed: bool) -> Iterator[pd.DataFrame]:
        """Every call on the state crosses to the JVM, so nothing is asked twice. A timer stands as long as moves wait."""
        value, held = self.settled.get(), [tuple(m) for m in self.moves.get()]
        before = [list(value[i : i + 3]) if value and value[i] is not None else None for i in (0, 3, 6)]
        waiting = held + new
        settled = apply_moves(before, [m for m in waiting if m[0] < passed])
        final = settled[2] is not None
        now = settled if final else apply_moves(before, waiting)
        left = [] if final else [m for m in waiting if m[0] >= passed]
        if settled[0] and not final:
            if settled != before:
                self.settled.update(tuple(x for step in settled for x in (step or [None] * 3)))
        elif value:
            self.settled.clear()
        if left:
            if left != held:
                self.moves.put(left)
            if not (held and changed):
                self.handle.registerTimer(max(passed, max(m[0] for m in left)) // 1000 + 1)
        elif held:
            self.moves.clear()
        if now[0] and (changed or final):
            yield _lifecycle_row(key[0], now, final)


def _lifecycle_row(handoff_id, steps: list, final: bool) -> pd.DataFrame:
    created, claimed, closed = steps
    times = [pd.to_datetime([m[0] if m else None], unit="us", utc=True) for m in steps]
    return pd.DataFrame(
        {
            "handoff_id": [handoff_id], "status": "closed" if closed else "claimed" if claimed else "new",
            "claimed_by": [claimed[2] if claimed else None], "created_at": times[0], "claimed_at": times[1], "closed_at": times[2], "final": [final],
        }
    )


@contextlib.contextmanager
def _state_provider(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which typed state needs."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def stream_lifecycle(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> None:
    """Fold lifecycle events (handoff_id, event, se, event_at, seq) into a table of changed handoffs per batch.

    The moves of a handoff count in event order, in whatever batches they arrive, as long as they are not more than
    ``delay`` late; older ones are dropped. Moves are held per handoff until the watermark has passed them, then folded away;
    closed handoffs leave the state then. A batch touches the state of the handoffs it names, and rewrites its own folder when repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    kind = stream.schema["handoff_id"].dataType.simpleString()
    moves = stream.where("event in ('create', 'claim', 'close') and handoff_id is not null").withWatermark("event_at", delay)
    folded = moves.groupBy("handoff_id").transformWithStateInPandas(Lifecycle(), LIFECYCLE.format(kind=kind), "Update", "EventTime")
    with _state_provider(stream.sparkSession):
        run_available(folded.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_lifecycle(table: DataFrame) -> DataFrame:
    """The newest row of each handoff. The first final row stands for good: what arrives for a handoff that has left the state is illegal."""
    first_final = F.when(F.col("final"), -F.col("batch_id"))
    return latest(table.withColumn("_settled", first_final), ["handoff_id"], ["_settled", "batch_id"]).drop("batch_id", "final", "_settled")
