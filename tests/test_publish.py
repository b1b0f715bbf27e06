"""A build is the old one or the new one, never parts of both."""

from __future__ import annotations

import os

import pytest
from test_marts import FILES

from fretwork.plans import marts, warehouse


def write(folder, **changed):
    folder.mkdir(exist_ok=True)
    for name, text in {**FILES, **changed}.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def seen(spark, out):
    """All that a reader can see."""
    names = [*warehouse.MARTS, *warehouse.DETAILS, "raw_orders", "load_audit"]
    return {name: sorted(map(str, warehouse.read_table(spark, out, name).collect())) for name in names}


MORE = FILES["orders"] + "O9,C2,K1,1,1.00,2022-11-05,completed\n"


@pytest.mark.parametrize("broken", ["customer_mart", "fct_recommendations", "inventory"])
def test_a_build_that_fails_leaves_the_old_one(spark, tmp_path, monkeypatch, broken):
    out = str(tmp_path / "warehouse")
    warehouse.build(spark, write(tmp_path / "raw"), out)
    before = seen(spark, out)
    held = warehouse.read_mart(spark, out, "dim_customers")

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(marts, broken, fail)
        with pytest.raises(RuntimeError, match="lost"):
            warehouse.build(spark, write(tmp_path / "raw", orders=MORE), out)
    assert seen(spark, out) == before
    assert len(os.listdir(f"{out}/builds")) == 2 and len(warehouse.published(spark, out)) == 1
    kept = warehouse.build(spark, str(tmp_path / "raw"), out, replace=False)
    assert sorted(map(str, kept.collect())) == before["load_audit"]
    warehouse.build(spark, str(tmp_path / "raw"), out)
    assert len(seen(spark, out)["raw_orders"]) == len(before["raw_orders"]) + 1
    assert sorted(map(str, held.collect())) == before["dim_customers"]  # a reader that opened the old build goes on reading it


def test_a_first_build_that_fails_is_none(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "warehouse")
    with monkeypatch.context() as patch:
        patch.setattr(warehouse, "audit_build", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            warehouse.build(spark, write(tmp_path / "raw"), out)
    assert warehouse.built(spark, out) is None and warehouse.current(spark, out) is None
    with pytest.raises(ValueError, match="nothing has been published"):
        warehouse.read_mart(spark, out, "inventory")
    warehouse.build(spark, str(tmp_path / "raw"), out, replace=False)
    assert warehouse.read_mart(spark, out, "inventory").count() == 2


def test_an_audit_that_fails_stops_the_build(spark, tmp_path):
    out, twice = str(tmp_path / "warehouse"), FILES["inventory"] + "P0001,3\n"
    with pytest.raises(warehouse.AuditError, match="inventory_key 1"):
        warehouse.build(spark, write(tmp_path / "raw", inventory=twice), out, strict=True)
    assert warehouse.built(spark, out) is None
    warehouse.build(spark, str(tmp_path / "raw"), out)
    report = {r.contract: r.n_violations for r in warehouse.read_table(spark, out, "build_audit").collect()}
    assert report == {"raw_rows": 0, "dim_products_key": 0, "dim_customers_key": 0, "fct_recommendations_key": 0, "inventory_key": 1}


def test_builds_at_the_same_time_and_old_ones(spark, tmp_path):
    out = str(tmp_path / "warehouse")
    for _ in range(3):
        warehouse.build(spark, write(tmp_path / "raw"), out)
    (_, first), (_, second), (_, third) = warehouse.published(spark, out)
    assert warehouse.current(spark, out) == third
    open(f"{out}/published/00000003-{'f' * 32}", "w").close()  # another builder took the same number
    assert warehouse.current(spark, out) == max(third, f"{out}/builds/{'f' * 32}")
    os.remove(f"{out}/published/00000003-{'f' * 32}")
    assert warehouse.drop_old_builds(spark, out, keep=2) == [first]
    assert [f for _, f in warehouse.published(spark, out)] == [second, third]
    assert not os.path.exists(first) and warehouse.read_mart(spark, out, "inventory").count() == 2
