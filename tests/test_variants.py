"""JSON parsed once: the same values as from the text, missing, malformed, large and deep texts, and what a scan reads."""

from __future__ import annotations

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fretwork.functions.jsonio import customer_snapshot
from fretwork.operators import transcripts
from fretwork.sources import variants

TEXTS = {
    "plain": '{ "name": "Ann", "skill": "beginner", "instrument": "drums", "budget": 12.5 }',
    "fewer": '{"name":"Bo"}',
    "null": '{"name":null,"budget":null}',
    "misfit": '{"name":"Cy","budget":"much"}',
    "long": json.dumps({"name": "D" * 500, "skill": "advanced", "budget": 7}),
    "list": "[1,2]",
    "malformed": '{"name": "Ed", ',
    "empty": "",
    "deep": "[" * 1500 + "]" * 1500,
    "missing": None,
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(TEXTS.items()), "handoff_id string, customer_snapshot string").withColumn(
        "recommended_products", F.when(F.col("handoff_id") == "plain", '["P1", "P2"]').when(F.col("handoff_id") == "long", '["' + "P" * 300 + '"]').otherwise("oops")
    )


@pytest.mark.parametrize("text_bytes", [variants.TEXT_BYTES, 200])
def test_same_values_as_from_the_text(spark, tmp_path, rows, text_bytes):
    """Also where the large texts are not parsed but looked up as text."""
    loaded = variants.load_json(rows, ["customer_snapshot", "recommended_products"], str(tmp_path / "t"), text_bytes)
    rest = {r.handoff_id for r in loaded.where("customer_snapshot_rest is not null").collect()}
    assert rest == ({"long", "deep"} if text_bytes == 200 else set())
    assert {r.handoff_id: r.customer_snapshot for r in loaded.collect()} == TEXTS
    got = {r.handoff_id: tuple(r)[1:] for r in variants.snapshots(loaded).collect()}
    none = (None, None, None, None)
    assert got["plain"] == ("Ann", "beginner", "drums", 12.5, ["P1", "P2"])
    assert got["fewer"] == ("Bo", None, None, None, []) and got["null"] == (*none, []) and got["misfit"] == ("Cy", None, None, None, [])
    assert got["long"] == ("D" * 500, "advanced", None, 7.0, ["P" * 300])
    for name in ("list", "malformed", "empty", "deep", "missing"):
        assert got[name] == (*none, []), name
    typed = rows.where("handoff_id in ('plain', 'fewer', 'null', 'long')").select("handoff_id", customer_snapshot(F.col("customer_snapshot")).alias("s"))
    assert {r.handoff_id: tuple(r.s) for r in typed.collect()} == {n: got[n][:4] for n in ("plain", "fewer", "null", "long")}


def test_scan_reads_paths_only(spark, tmp_path, rows):
    loaded = variants.load_json(rows.where("handoff_id = 'plain'"), ["customer_snapshot"], str(tmp_path / "t"))
    plan = loaded.select(variants.at("customer_snapshot", "$.name", "string"))._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<customer_snapshot_json:struct<0:string>,customer_snapshot_rest:string")
    columns = pq.read_schema(glob.glob(str(tmp_path / "t/part-*.parquet"))[0]).field("customer_snapshot_json").type
    assert "typed_value" in [columns.field(i).name for i in range(columns.num_fields)]  # shredded


def test_messages(spark, tmp_path):
    turns = spark.createDataFrame(
        [("s", i, "user" if i % 2 else "assistant", f"text {i} \"q\"", ["P1"] if i == 2 else None) for i in range(5)] + [("t", 0, None, "", [])],
        "session_id string, turn int, role string, content string, product_ids array<string>",
    )
    pages = transcripts.pack_messages(turns, page_turns=2).unionByName(
        spark.createDataFrame([("x", 0, "[]"), ("y", 0, None), ("z", 0, "no json")], "session_id string, page_no bigint, messages string")
    )
    want = sorted(map(str, transcripts.unpack_messages(pages, all_roles=True).collect()))
    assert len(want) == 6
    for text_bytes in (variants.TEXT_BYTES, 10):
        loaded = variants.load_json(pages, ["messages"], str(tmp_path / f"m{text_bytes}"), text_bytes)
        assert sorted(map(str, variants.message_rows(loaded).collect())) == want
    roles = variants.message_rows(loaded, "array<struct<role:string>>")
    assert roles.columns == ["session_id", "page_no", "position", "role"] and roles.count() == 6


def test_clashing_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "handoff_id string, customer_snapshot string")
    assert variants.load_json(empty, ["customer_snapshot"], str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError, match="customer_snapshot_rest"):
        variants.with_json(empty.withColumn("customer_snapshot_rest", F.lit(1)), ["customer_snapshot"])
