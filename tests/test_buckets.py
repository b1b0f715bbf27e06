"""Keyed table in buckets: merges, untouched files, lost compactions."""

from __future__ import annotations

import os
import random

import pytest

from fretwork.sources import buckets, keyed
from fretwork.sources.buckets import BucketTable

SCHEMA = "k string, v int, m string"


def table_of(spark, tmp_path, n=8):
    return BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, ["k"], ["v"], n)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def base_files(path):
    return {os.path.join(place, n) for place, _, names in os.walk(f"{path}/base") for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("log_rows", [1000, 0])
def test_equals_upserts_one_by_one(spark, tmp_path, monkeypatch, log_rows):
    """Late, equal and null versions and a null key, with and without compactions in between, by broadcast and by shuffle."""
    monkeypatch.setattr(buckets, "LOG_ROWS", log_rows)
    rng, table = random.Random(1), table_of(spark, tmp_path)
    want = spark.createDataFrame([], SCHEMA)
    assert rows_of(table.read()) == [] and table.compact() == []
    for i in range(5):
        rows = [(rng.choice(["a", "b", "c", "d", None, f"x{i}"]), rng.choice([None, 1, 2, 3]), f"{i} {j}") for j in range(6)]
        rows = spark.createDataFrame(list({r[:2]: r for r in rows}.values()), SCHEMA)
        table.append(rows)
        want = keyed.upsert(want, keyed.latest(rows, ["k"], ["v"]), ["k"], ["v"])
        if i in (0, 1, 3):
            assert table.compact()
        assert rows_of(table.read()) == rows_of(want)
    asked = spark.createDataFrame([("a",), (None,), ("none",)], "k string")
    assert rows_of(table.read(among=asked)) == [r for r in rows_of(want) if r[0] in ("a", None)]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.append(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(200)], SCHEMA))
    assert table.compact() == list(range(8))
    before, folders = base_files(table.path), table.manifest()[0]
    table.append(spark.createDataFrame([("k5", 2, "new"), ("k5", 0, "late")], SCHEMA))
    (touched,) = table.compact()
    after = table.manifest()[0]
    assert {b for b in folders if folders[b] != after[b]} == {touched}
    assert before < base_files(table.path) and len(base_files(table.path)) == 9
    assert ("k5", 2, "new") in rows_of(table.read()) and table.read().count() == 200
    gone = table.clean()
    assert len(gone) == 3 and len(base_files(table.path)) == 8  # two parts of the log, one bucket
    assert ("k5", 2, "new") in rows_of(table.read()) and table.read().count() == 200


def test_the_base_is_not_shuffled(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.append(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(50)], SCHEMA))
    table.compact()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table.read())
    table.append(spark.createDataFrame([("k5", 2, "new"), ("n", 2, "new")], SCHEMA))
    assert table.read().count() == 51
    shuffles = [line for line in plan(table.read()).splitlines() if "Exchange" in line and "Broadcast" not in line]
    lines = plan(table.read()).splitlines()
    # All that is shuffled is the log, to find its newest rows: below each exchange stands a scan of the log, never of the base.
    for at in [i for i, line in enumerate(lines) if line in shuffles]:
        scan = next(line for line in lines[at:] if "FileScan" in line)
        assert "/log/" in scan and "/base/" not in scan


@pytest.mark.parametrize("step", ["_publish", "write"])
def test_a_lost_compaction_harms_nothing(spark, tmp_path, monkeypatch, step):
    table = table_of(spark, tmp_path)
    table.append(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA))
    table.compact()
    table.append(spark.createDataFrame([("a", 2, "z")], SCHEMA))
    before = rows_of(table.read())

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(*((BucketTable, "_publish", lost) if step == "_publish" else (buckets, "latest", lost)))
        with pytest.raises(RuntimeError, match="lost"):
            table.compact()
    assert rows_of(table.read()) == before == [("a", 2, "z"), ("b", 1, "y")]
    table.compact()
    assert rows_of(table.read()) == before and table._open_parts(table.manifest()[1]) == []
