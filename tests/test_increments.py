"""Customer totals from deltas: equal to a rebuild, late lines, nulls, a delta that was lost half way."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from fretwork.plans import increments, marts
from fretwork.plans.increments import CustomerTotals
from fretwork.session import materialize
from fretwork.sources.buckets import BucketTable

LINES = "customer_id string, order_id string, product_id string, line_total decimal(18,2), order_date date"


def some_lines(rng, n, hot="C0"):
    def one():
        customer = hot if rng.random() < 0.4 else rng.choice(["C1", "C2", "C3", None])
        order = rng.choice([None, *[f"{customer}-{i}" for i in range(6)]])
        money = rng.choice([None, "1.10", "20.00", "-3.30"])
        return customer, order, rng.choice(["P1", "P2", "P3", None]), money, dt.date(2024, 1, rng.randint(1, 28))

    return [one() for _ in range(n)]


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(a, b, c, m and Decimal(m), d) for a, b, c, m, d in rows], LINES)


def rebuilt(spark, rows):
    """customer -> totals by plain Python."""
    out = {}
    for customer in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == customer]
        money = [round(float(r[3]) * 100) for r in own if r[3] is not None]
        out[customer] = (
            len({r[1] for r in own} - {None}), len({r[2] for r in own}), sum(money) if money else None,
            max(r[4] for r in own), min(r[4] for r in own),
        )
    return out


def got(totals):
    cents = lambda v: None if v is None else round(v * 100)
    return {
        r.customer_id: (r.total_orders, r.n_products, cents(r.lifetime_value), r.last_order_date, r.first_order_date)
        for r in totals.totals().collect()
    }


def test_deltas_equal_a_rebuild(spark, tmp_path):
    rng, totals, all_lines = random.Random(3), CustomerTotals(spark, str(tmp_path / "t"), 4), []
    assert got(totals) == {}
    for delta in (1, 2, 3):
        rows = some_lines(rng, 25)
        assert totals.apply(frame(spark, rows), delta)
        all_lines += rows
        assert got(totals) == rebuilt(spark, all_lines)
        if delta == 2:
            totals.compact()
            assert got(totals) == rebuilt(spark, all_lines)
    stats = {r.customer_id: (r.total_orders, r.lifetime_value) for r in marts.customer_stats(marts.order_items(frame(spark, all_lines))).collect()}
    assert stats == {r.customer_id: (r.total_orders, r.lifetime_value) for r in totals.totals().collect()}
    assert {tuple(r) for r in totals.bridge().collect()} == {(r[0], r[2]) for r in all_lines}
    assert not totals.apply(frame(spark, some_lines(rng, 5)), 3)  # done before, passed over
    with pytest.raises(ValueError):
        totals.apply(frame(spark, some_lines(rng, 5)), 5)
    assert totals.apply(frame(spark, []), 4)
    assert got(totals) == rebuilt(spark, all_lines)


@pytest.mark.parametrize("fails_at, compact", [("products", False), ("customers", False), ("customers", True)])
def test_a_lost_delta_is_applied_again(spark, tmp_path, monkeypatch, fails_at, compact):
    rng, totals = random.Random(4), CustomerTotals(spark, str(tmp_path / "t"), 4)
    first, second = some_lines(rng, 20), some_lines(rng, 20)
    totals.apply(frame(spark, first), 1)
    append = BucketTable.append

    def failing(table, rows):
        if table.path.endswith(fails_at):
            raise OSError("lost")
        append(table, rows)

    monkeypatch.setattr(BucketTable, "append", failing)
    with pytest.raises(OSError):
        totals.apply(frame(spark, second), 2)
    monkeypatch.undo()
    assert totals.applied() == 1
    if compact:
        totals.compact()
    assert totals.apply(frame(spark, second), 2)
    assert got(totals) == rebuilt(spark, first + second)


def test_old_lines_and_other_buckets_are_not_read(spark, tmp_path):
    """A delta of one customer reads its own rows and one bucket of each table, with a late line of an old order."""
    totals = CustomerTotals(spark, str(tmp_path / "t"), 16)
    old = [(f"C{i}", f"O{i}", "P1", "5.00", dt.date(2024, 1, 5)) for i in range(200)]
    totals.apply(frame(spark, old), 1)
    totals.compact()
    late = frame(spark, [("C7", "O7", "P2", "2.50", dt.date(2024, 1, 2))])
    read = totals.orders.read(among=late.select("customer_id", "order_id"))
    files = {f for f in read.inputFiles()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    totals.apply(late, 2)
    row = totals.totals().where("customer_id = 'C7'").first()
    assert (row.total_orders, row.n_products, float(row.lifetime_value), str(row.first_order_date)) == (1, 2, 7.5, "2024-01-02")
    assert totals.totals().count() == 200


def test_each_row_of_a_delta_is_written_once(spark, tmp_path, monkeypatch):
    """Only the summed lines stand aside; the three tables take their rows directly, also where a customer buys nothing new."""
    aside = []
    monkeypatch.setattr(increments, "materialize", lambda df, name: aside.append(name) or materialize(df, name))
    rng, totals = random.Random(5), CustomerTotals(spark, str(tmp_path / "t"), 4)
    lines = some_lines(rng, 30)
    for delta in (1, 2):
        totals.apply(frame(spark, lines), delta)
    assert aside == ["delta-items"] * 2
    assert got(totals) == rebuilt(spark, lines * 2)
