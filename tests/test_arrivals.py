"""Files that arrive over several runs: each loaded once, whatever is lost in between."""

from __future__ import annotations

import os

import pytest

from fretwork.sources.raw_files import load_raw
from fretwork.streaming import arrivals

HEADER = "product_id,quantity\n"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    text = HEADER + "".join(f"{a},{b}\n" for a, b in rows)
    draft = folder / f".{name}"
    draft.write_text(text)
    draft.rename(folder / name)


def loaded(spark, out):
    return sorted((r.product_id, r.quantity) for r in arrivals.read_arrivals(spark, out, "inventory").collect())


def audited(spark, out):
    rows = arrivals.file_audit(spark, out, "inventory").collect()
    assert {r.table_name for r in rows} == {"raw_inventory"}
    return sorted((r.source_file.rsplit("/", 1)[1], r.row_count) for r in rows)


def test_three_files_in_two_runs_equal_a_batch_load(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    files = {"a.csv": [("P1", "1"), ("P2", "x")], "b.csv": [("P1", "1"), ("P 3", "")], "c.csv": [("P4", "4")] * 3}
    for name in ("a.csv", "b.csv"):
        put(src, name, files[name])
    arrivals.load_arrivals(spark, str(src), "inventory", out, checkpoint, max_files=1)
    assert audited(spark, out) == [("a.csv", 2), ("b.csv", 2)]
    put(src, "c.csv", files["c.csv"])
    put(src, "empty.csv", [])
    for _ in range(2):  # the second run finds nothing new
        arrivals.load_arrivals(spark, str(src), "inventory", out, checkpoint)
    assert audited(spark, out) == [("a.csv", 2), ("b.csv", 2), ("c.csv", 3)]
    put(tmp_path / "batch", "inventory.csv", [row for rows in files.values() for row in rows])
    audit = load_raw(spark, str(tmp_path / "batch"), str(tmp_path / "whole"), ["inventory"]).collect()
    batch = spark.read.parquet(str(tmp_path / "whole/raw_inventory")).collect()
    assert sorted(map(str, arrivals.read_arrivals(spark, out, "inventory").select("product_id", "quantity").collect())) == sorted(map(str, batch))
    assert sum(n for _, n in audited(spark, out)) == audit[0]["row_count"]


def test_a_lost_batch_is_loaded_once(spark, tmp_path, monkeypatch):
    """The rows are written, the audit is not: readers see nothing of the batch; the next run loads its files once."""
    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put(src, "a.csv", [("P1", "1")])
    arrivals.load_arrivals(spark, str(src), "inventory", out, checkpoint)
    put(src, "b.csv", [("P2", "2"), ("P3", "3")])
    monkeypatch.setattr(arrivals.F, "count", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        arrivals.load_arrivals(spark, str(src), "inventory", out, checkpoint)
    monkeypatch.undo()
    assert os.path.isdir(f"{out}/raw_inventory/batch_id=1")
    assert loaded(spark, out) == [("P1", "1")]
    arrivals.load_arrivals(spark, str(src), "inventory", out, checkpoint)
    assert loaded(spark, out) == [("P1", "1"), ("P2", "2"), ("P3", "3")]
    assert audited(spark, out) == [("a.csv", 1), ("b.csv", 2)]
