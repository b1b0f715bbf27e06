"""Keyed tables, the handoff queue and the streams."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from fretwork.operators import handoffs
from fretwork.schemas import AGENT_HANDOFFS
from fretwork.sources import keyed
from fretwork.streaming import events as live
from fretwork.streaming import state
from fretwork.streaming.files import read_parquet_stream

MOVES = "handoff_id int, event string, se string, event_at timestamp, seq bigint"
START = dt.datetime(2024, 1, 1)


def test_upsert_is_idempotent_and_the_update_wins_ties(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, m string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 1, "late"), ("c", None, "n")], "k string, v int, m string")
    once = keyed.upsert(old, new, ["k"], ["v"])
    twice = keyed.upsert(once, new, ["k"], ["v"])
    want = {("a", 1, "z"), ("b", 2, "y"), ("c", None, "n")}
    assert set(map(tuple, once.collect())) == want == set(map(tuple, twice.collect()))


def test_append_only_table(spark, tmp_path):
    path, folded = str(tmp_path / "t"), str(tmp_path / "folded")
    keyed.create_if_absent(spark, path, AGENT_HANDOFFS)
    keyed.create_if_absent(spark, path, AGENT_HANDOFFS)
    requests = spark.createDataFrame([("r1", ["P1"], None), ("r2", [], "high")], "request_key string, recommended_product_ids array<string>, priority string")
    rows = handoffs.new_handoffs(requests)
    keyed.append(rows, path)
    keyed.append(handoffs.new_handoffs(requests), path)  # the same requests once more
    key, version = ["handoff_id"], ["created_at"]
    table = keyed.read(spark, path, AGENT_HANDOFFS, key, version)
    got = {r.handoff_id: r for r in table.collect()}
    assert len(got) == 2 and {r.status for r in got.values()} == {"new"}
    assert {(r.priority, r.recommended_products) for r in got.values()} == {("medium", '["P1"]'), ("high", "[]")}
    assert all(len(i) == 18 and i.startswith("H-") for i in got)
    keyed.rewrite(spark, path, folded, AGENT_HANDOFFS, key, version)
    assert spark.read.parquet(folded).count() == 2


def test_queue_order_and_metrics(spark):
    rows = [("h1", "low", "new", 3), ("h2", "high", "new", 1), ("h3", "high", "claimed", 2), ("h4", "medium", "closed", 1), ("h5", None, "new", None)]
    df = spark.createDataFrame(rows, "handoff_id string, priority string, status string, day int").withColumn(
        "created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp")
    )
    assert [r.handoff_id for r in handoffs.handoff_queue(df).collect()] == ["h3", "h2", "h4", "h1", "h5"]
    assert tuple(handoffs.handoff_metrics(df).first()) == (5, 3, 1, 1, 1)


def random_moves(seed, n=600, handoffs_n=25):
    rng = random.Random(seed)
    return [
        (rng.randrange(handoffs_n), rng.choice(["create", "claim", "close", "close", "view"]), rng.choice(["A", "B"]), START + dt.timedelta(seconds=rng.randrange(500)), i)
        for i in range(n)
    ]


def walk(moves, known=None):
    """Handoff states after the moves, one by one."""
    states = dict(known or {})
    for key, event, se, at, _ in sorted(moves, key=lambda m: (m[3], m[4])):
        status = states.get(key)
        if event == "create" and status is None:
            states[key] = ("new", None)
        elif event == "claim" and status == ("new", None):
            states[key] = ("claimed", se)
        elif event == "close" and status == ("claimed", se):
            states[key] = ("closed", se)
    return states


def test_fold_equals_a_walk_through_all_moves(spark):
    moves = random_moves(1)
    got = {r.handoff_id: (r.status, r.claimed_by) for r in handoffs.fold_lifecycle(spark.createDataFrame(moves, MOVES)).collect()}
    assert got == walk(moves)


def test_lifecycle_stream_over_many_batches(spark, tmp_path):
    """Moves in random order over the batches give the state of all moves in event order."""
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    moves = random_moves(2, 250)
    random.Random(5).shuffle(moves)
    spark.createDataFrame([], MOVES).write.parquet(source)
    for i in range(5):
        spark.createDataFrame(moves[i * 50 : (i + 1) * 50], MOVES).coalesce(1).write.mode("append").parquet(source)
        state.stream_lifecycle(read_parquet_stream(spark, source), path, str(tmp_path / "checkpoint"))
    got = {r.handoff_id: (r.status, r.claimed_by) for r in state.read_lifecycle(spark.read.parquet(path)).collect()}
    assert got == walk(moves)


def test_lifecycle_settles_what_the_watermark_has_passed(spark, tmp_path):
    """A claim before its create counts; a move that is too late does not."""
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    hours = [[(1, "claim", "A", 2), (2, "create", "A", 1)], [(1, "create", "B", 1), (3, "create", "A", 90)], [(2, "claim", "A", 3), (3, "claim", "B", 91)], [(3, "close", "B", 92)]]
    spark.createDataFrame([], MOVES).write.parquet(source)
    for i, rows in enumerate(hours):
        rows = [(k, e, se, START + dt.timedelta(hours=h), 10 * i + n) for n, (k, e, se, h) in enumerate(rows)]
        spark.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(source)
        state.stream_lifecycle(read_parquet_stream(spark, source), path, str(tmp_path / "checkpoint"), "10 hours")
    got = {r.handoff_id: (r.status, r.claimed_by) for r in state.read_lifecycle(spark.read.parquet(path)).collect()}
    assert got == {1: ("claimed", "A"), 2: ("new", None), 3: ("closed", "B")}


def test_closed_handoffs_leave_the_state(spark, tmp_path):
    """Of 200 handoffs, 190 closed, the open ones are all that stays; what arrives for a closed one later changes nothing."""
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    at = lambda hour, n: START + dt.timedelta(hours=hour, seconds=n)
    first = [(k, e, "A", at(h, k), 3 * k + h) for k in range(200) for h, e in enumerate(["create", "claim", "close"]) if e != "close" or k >= 10]
    first += [(k, "close", "B", at(2, k), 1000 + k) for k in range(5)] + [(900, "close", "A", at(0, 0), 5000)]
    later = [[(500, "create", "A", at(50, 0), 6000)], [(7, "close", "A", at(60, 0), 6001), (50, "create", "B", at(61, 0), 6002)], [(501, "create", "A", at(90, 0), 6003)]]
    spark.createDataFrame([], MOVES).write.parquet(source)
    for rows in [first, *later]:
        spark.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(source)
        state.stream_lifecycle(read_parquet_stream(spark, source), path, checkpoint, "10 hours")
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    with state._state_provider(spark):
        open_ones = {r["key"][0] for r in read("settled").select("key").collect()}
    assert open_ones - {50} == {*range(10), 500} - {7}
    table = {r.handoff_id: (r.status, r.claimed_by) for r in state.read_lifecycle(spark.read.parquet(path)).collect()}
    assert table == walk([*first, *(m for rows in later for m in rows)])
    assert table[50] == ("closed", "A") and table[7] == ("closed", "A") and 900 not in table


def test_transcript_stream_keeps_the_last_write(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    schema = "session_id string, page_no bigint, messages string, updated_at timestamp"
    for rows in [[("s", 0, "new", START + dt.timedelta(1)), ("t", 0, "t", START)], [("s", 0, "late", START), ("t", 0, "t2", START)]]:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        state.stream_transcripts(read_parquet_stream(spark, source), path, checkpoint)
    got = {r.session_id: r.messages for r in state.read_transcripts(spark.read.parquet(path)).collect()}
    assert got == {"s": "new", "t": "t2"}


def test_a_shorter_transcript_replaces_the_longer_one(spark, tmp_path):
    """Pages of both versions come mixed over two batches; nothing of the older version stays."""
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    schema = "session_id string, page_no bigint, messages string, updated_at timestamp"
    late = START + dt.timedelta(1)
    for rows in [[("s", 0, "new 0", late), ("s", 2, "old 2", START)], [("s", 1, "new 1", late), ("s", 0, "old 0", START), ("s", 1, "old 1", START)]]:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        state.stream_transcripts(read_parquet_stream(spark, source), path, checkpoint)
    assert sorted(r.messages for r in state.read_transcripts(spark.read.parquet(path)).collect()) == ["new 0", "new 1"]


def test_metrics_stream_updates_windows(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    schema = "ts timestamp, status string, priority string"
    for minute in (1, 2):
        rows = [(START + dt.timedelta(minutes=minute), "new", "high"), (START + dt.timedelta(hours=1, minutes=minute), "closed", "low")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        live.stream_queue_metrics(read_parquet_stream(spark, source), "ts", "1 hour", "2 hours", path, checkpoint)
    last = keyed.latest(spark.read.parquet(path), ["window_start"], ["batch_id"])
    assert [(r.total, r.new, r.closed, r.urgent) for r in last.orderBy("window_start").collect()] == [(2, 2, 0, 2), (2, 0, 2, 0)]


def test_dedup_stream_across_batches(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):
        spark.createDataFrame([(1, START), (2, START), (1, START)], "id int, ts timestamp").write.mode("append").parquet(source)
        live.stream_dedup(read_parquet_stream(spark, source), ["id"], "ts", "1 hour", path, checkpoint)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
