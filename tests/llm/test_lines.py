from __future__ import annotations

import hashlib
import random

from oracle import connect, difference
from pyspark.sql import functions as F

from fretwork.llm import lines
from fretwork.session import materialize

SCHEMA = "doc_id long, text string"
LONG = "This line is long enough to be looked for in others"


def brute(rows, length=40, documents=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if len(holders.get(key(x), ())) < documents or doc == max(holders[key(x)], key=lambda d: (d is not None, d or 0))
        ]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = lines.deduplicated(docs, materialize(lines.keep_bitmaps(docs, **kwargs), "bitmaps"))
    return sorted(map(tuple, found.withColumn("text", F.sha2("text", 256)).collect()), key=str)


def test_random_texts(spark):
    rng = random.Random(1)
    pool = ["", "a", "  b ", *(f"line {i} " + "x" * rng.randrange(20) for i in range(30))]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    rows += [(500, "\n".join(pool) * 300)]
    got = result(spark, rows, min_length=10, min_documents=3)
    assert got == brute(rows, 10, 3)
    assert sum(r[2] for r in got) > 200


def test_rules(spark):
    rows = [(i, f"head {i}\n {LONG.upper()}\t\nmiddle\n{LONG}\n") for i in range(5)] + [(9, LONG[:39])] * 7 + [(10, LONG)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] in range(5)] == [2] * 5 and [r[2] for r in got if r[0] == 10] == [0]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, LONG), (None, LONG), (1, None), (2, ""), (3, "\n"), *[(i, f"{LONG}\n\n") for i in range(4, 8)], (7, f"{LONG}\n\n"), (7, LONG)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert result(spark, []) == []
    wide = spark.createDataFrame([(1, "a", 5, "x")], "doc_id long, text string, kept int, n_dropped string")
    assert lines.deduplicated(wide.select("doc_id", "text"), lines.keep_bitmaps(wide)).count() == 1


def test_a_document_may_lose_every_line(spark):
    rows = [(i, LONG) for i in range(6)]
    assert {r[3] for r in result(spark, rows) if r[2]} == {hashlib.sha256(b"").hexdigest()}


def test_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.keep_bitmaps(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    shared = lines.shared_keys(lines.line_hashes(docs, 40), 5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in shared and "Sort [" in shared


def test_one_join_at_every_size(spark):
    """The same join with the broadcast threshold as it is and without any broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bitmaps = materialize(lines.keep_bitmaps(docs), "bitmaps")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for threshold in (before, "-1"):
            spark.conf.set(key, threshold)
            plan = lines.deduplicated(docs, bitmaps)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set(key, before)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(lines.query(spark, sf), connect(sf), lines.SQL) is None
