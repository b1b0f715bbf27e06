"""Conversion as a stream: late purchases, late recommendations, none bought, repeats, rows before and after the horizon."""

from __future__ import annotations

import datetime as dt
import os

from fretwork.plans import analytics, staging
from fretwork.streaming import conversion, files
from fretwork.streaming.files import read_parquet_stream
from fretwork.workload import checks, shop, streams

ASKS = "customer_id string, product_id string, created_at timestamp"
BUYS = "customer_id string, product_id string, order_date date"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def ask(customer, product, n, hour=9):
    return customer, product, day(n, hour)


def buy(customer, product, n):
    return customer, product, day(n).date()


def run(spark, tmp_path, deliveries, horizon="10 days", delay="3 days"):
    paths = {n: str(tmp_path / n) for n in ("asks", "buys", "table", "checkpoint")}
    asks, buys = [], []
    for new_asks, new_buys in deliveries:
        spark.createDataFrame(new_asks, ASKS).write.mode("append").parquet(paths["asks"])
        spark.createDataFrame(new_buys, BUYS).write.mode("append").parquet(paths["buys"])
        asks, buys = asks + new_asks, buys + new_buys
        streams = [read_parquet_stream(spark, paths[n]) for n in ("asks", "buys")]
        conversion.stream_conversions(*streams, horizon, delay, paths["table"], paths["checkpoint"])
    found = conversion.first_conversions(spark.read.parquet(paths["table"])).collect()
    got = {(r.customer_id, r.product_id, r.created_at): r.converted_on for r in found}
    frames = spark.createDataFrame(asks, ASKS), spark.createDataFrame(buys, BUYS)
    return got, frames, conversion.settled_before(*frames, horizon, delay).first()["settled"], paths


def test_equals_the_table_up_to_the_horizon(spark, tmp_path):
    first = (
        [ask("a", "P1", 1), ask("a", "P1", 1), ask("a", "P2", 2), ask("b", "P1", 3), ask("c", None, 3), (None, "P1", day(3)), ask("d", "P1", 4, 0), ("e", "P1", None)],
        [buy("a", "P1", 1), buy("a", "P1", 4), buy("a", "P1", 4), buy("a", "P1", 5), buy("b", "P1", 14), buy("d", "P1", 4), ("e", "P1", None), buy(None, "P1", 4), buy("z", "P9", 15)],
    )
    # The watermark stands at 12 days less the delay: the purchase of day 10 and the recommendation of day 10 are late, not too late.
    second = (
        [ask("b", "P2", 10), ask("f", "P1", 12), ask("g", "P1", 30), ask("g", "P1", 44), ask("g", "P2", 44)],
        [buy("b", "P2", 13), buy("a", "P2", 13), buy("f", "P1", 22), buy("f", "P1", 23), buy("g", "P1", 44), buy("z", "P9", 45)],
    )
    got, (asks, buys), settled, _ = run(spark, tmp_path, [first, second])
    # Whole table, an order counts up to the horizon only.
    whole = {
        (r.customer_id, r.product_id, r.created_at): r.converted_on
        if r.converted_on and dt.datetime.combine(r.converted_on, dt.time()) <= r.created_at + dt.timedelta(days=10) else None
        for r in analytics.conversion(asks.where("created_at is not null"), buys).collect()
    }
    want = {k: v for k, v in whole.items() if k[2] < settled}
    assert {k: v for k, v in got.items() if k[2] < settled} == want
    assert len(want) == 9 and want["a", "P1", day(1, 9)] == day(4).date() and want["a", "P2", day(2, 9)] is None
    assert want["f", "P1", day(12, 9)] == day(22).date() and want["b", "P1", day(3, 9)] is None
    # What is not final yet shows up only where it has converted.
    assert all(v is not None for k, v in got.items() if k[2] >= settled)
    assert ("g", "P2", day(44, 9)) not in got


def test_nothing_is_final_without_orders(spark, tmp_path):
    got, _, settled, _ = run(spark, tmp_path, [([ask("a", "P1", 1), ask("a", "P1", 90)], [])])
    assert got == {} and settled is None


def test_state_shrinks(spark, tmp_path):
    """After the horizon the join holds the last rows only."""
    deliveries = [
        ([ask(f"c{i}", "P1", base + i % 3) for i in range(50)], [buy(f"c{i}", "P1", base + 5) for i in range(50)])
        for base in (0, 40, 80, 120)
    ]
    got, _, _, paths = run(spark, tmp_path, deliveries)
    # 200 recommendations and 200 orders came in; those of the last two deliveries can still be waited for.
    state = f"{paths['checkpoint']}/state"
    names = [f for f in os.listdir(state) if f.isdigit()]
    held = sum(
        spark.read.format("statestore").option("operatorId", op).option("joinSide", side).load(paths["checkpoint"]).count()
        for op in names if os.path.isdir(f"{state}/{op}/0/left-keyToNumValues") for side in ("left", "right")
    )
    assert 0 < held <= 200
    assert sum(v is not None for v in got.values()) == 200


def test_large_deliveries_come_in_parts(spark, tmp_path, monkeypatch):
    """No batch takes in much more than ``PART_ROWS`` rows, whatever the size of a delivery, and the result is that of the whole tables."""
    orders = [(i, i % 40, "OF"[i % 2], 10.0, day(i % 600, 0), "2-HIGH") for i in range(1200)] + [(1200, 3, "F", 1.0, None, "2-HIGH")]
    lines = [(o, (o * 7 + n) % 4, 1, n, 1.0, 5.0, 0.0, 0.0, "N", "O", day(0)) for o in range(1201) for n in range(2)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, names).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    names += ", l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    batches = []

    def run(writer, checkpoint):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        batches.extend(p.numInputRows for p in query.recentProgress)

    monkeypatch.setattr(files, "run_available", run)
    monkeypatch.setattr(streams, "PART_ROWS", 1000, raising=False)
    got = streams.stream_conversion(spark, str(tmp_path)).collect()
    assert sum(batches) > 3500 and max(batches) < 1300
    asked, bought = checks.recommendations(spark, str(tmp_path)), staging.stg_orders(shop.raw_orders(spark, str(tmp_path)))
    settled = conversion.settled_before(asked, bought, "90 days", "1 day").first()["settled"]
    want = {}
    for r in analytics.conversion(asked.where("created_at is not null"), bought).collect():
        if r.created_at < settled:
            late = r.converted_on is None or dt.datetime.combine(r.converted_on, dt.time()) > r.created_at + dt.timedelta(days=90)
            want[r.customer_id, r.product_id, str(r.created_at.date())] = None if late else str(r.converted_on)
    assert {(r.customer_id, r.product_id, r.created_on): r.converted_on for r in got} == want and len(got) == len(want) > 1000
    assert sum(v is not None for v in want.values()) > 10


def test_parts_without_rows_or_times(spark):
    times = "_at long"
    assert streams.arrival_cuts(spark.createDataFrame([], times), None) == []
    assert streams.arrival_cuts(spark.createDataFrame([(None,), (5,)], times), 5) == [5]


def test_rows_of_the_horizon_are_dealt_out(spark, tmp_path, monkeypatch):
    """Where the rows of 91 days are too many for one state, no stream's join keeps more than those of a slice, and the result is that of one stream."""
    orders = [(i, i % 40, "OF"[i % 2], 10.0, day(i % 600, 0), "2-HIGH") for i in range(1200)] + [(1200, None, "F", 1.0, day(9, 0), "2-HIGH"), (1201, 3, "F", 1.0, None, "2-HIGH")]
    lines = [(o, (o * 7 + n) % 4 if n else None, 1, n, 1.0, 5.0, 0.0, 0.0, "N", "O", day(0)) for o in range(1202) for n in range(2)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, names).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    names += ", l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = {tuple(r) for r in streams.stream_conversion(spark, str(tmp_path)).collect()}
    held, runs = [], []

    def run(writer, checkpoint):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(checkpoint)
        held.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)

    monkeypatch.setattr(files, "run_available", run)
    monkeypatch.setattr(streams, "PART_ROWS", 600)
    monkeypatch.setattr(streams, "HELD_ROWS", 250, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = [tuple(r) for r in streams.stream_conversion(spark, str(tmp_path)).collect()]
    assert len(got) == len(whole) > 1000 and set(got) == whole
    # At the end of a delivery one stream keeps 186 rows, those of the last 91 days.
    assert len(set(runs)) == 3 and len(runs) == 6 and 0 < max(held) < 120, held
    assert not any(os.path.exists(checkpoint) for checkpoint in runs)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_every_slice_sees_the_end_of_a_stream(spark):
    """A pair alone in its slice is as final as it is in one stream, also where the last rows belong to other pairs."""
    rows = [(f"c{i}", f"P{i % 3}", i) for i in range(50)]
    frame = spark.createDataFrame(rows, "customer_id string, product_id string, _at long")
    by_slice = {}
    for r in streams.in_slices(frame, frame["_at"], 4).collect():
        by_slice.setdefault(r["_slice"], []).append((r["customer_id"], r["product_id"], r["_at"]))
    assert sorted(by_slice) == [0, 1, 2, 3] and all(rows[-1] in found for found in by_slice.values())
    assert sorted({r for found in by_slice.values() for r in found}) == sorted(rows) and sum(map(len, by_slice.values())) == 54
    nothing = streams.in_slices(frame.where("_at < 0"), frame["_at"], 4)
    assert nothing.count() == 0 and "_slice" in nothing.columns
