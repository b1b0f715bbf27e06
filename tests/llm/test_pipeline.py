"""Each stage of the pipeline on its own input against plain Python (the mixture against its SQL), and the chain as a whole."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from test_decontamination import brute as brute_overlaps
from test_quality import plain_weights
from test_simhash import brute as brute_groups
from test_token_files import expected as expected_tokens
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fretwork.llm import mixing, quality
from fretwork.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input of every stage, and at last the result of the last one."""
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SF), f"test-{name}"))
    return frames


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in cp.STAGES] == [
        "quality_classifier", "near_duplicates", "benchmark_decontamination", "source_mixture", "token_output",
    ]
    assert all(frame.columns == steps[0].columns for frame in steps[1:-1])
    counts = [frame.count() for frame in steps]
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in quality.score(steps[0], labels).collect()}
    known = labels.collect()
    docs = texts(steps[0])
    want = plain_weights(docs, {r.doc_id for r in known if r.quality == 1 and r.toxic == 0}, quality.BITS)
    assert all(abs(1000 * rows[d].mean_ratio - want[d]) < 0.05 for d, _ in docs)
    k = round(sum(r.quality == 1 for r in known) / len(known) * len(docs))
    best = sorted(rows.values(), key=lambda r: -r.key)[:k]
    assert sorted(texts(steps[1])) == sorted((d, t) for d, t in docs if d in {r.doc_id for r in best})


def test_near_duplicate_stage(steps):
    docs = texts(steps[1])
    names = {doc: first for doc, _, first in brute_groups(docs)}
    assert sorted(texts(steps[2])) == sorted((d, t) for d, t in docs if names[d] == d)


def test_decontamination_stage(spark, steps):
    docs = texts(steps[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {doc for doc, hit, *_ in brute_overlaps(docs, items) if hit}
    assert sorted(texts(steps[3])) == sorted((d, t) for d, t in docs if d not in dirty)


def test_mixture_stage(steps):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in steps[3].collect()], steps[3].toArrow().schema))
    taken = {doc: -(-n // size) if size else 0 for doc, n, size in con.execute(f"SELECT doc_id, taken, size FROM ({mixing.SQL})").fetchall()}
    want = sorted((d, t) for d, t in texts(steps[3]) for _ in range(taken[d]))
    assert sorted(texts(steps[4])) == want


def test_token_stage(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    got = [tuple(r) for r in steps[5].select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == expected_tokens(texts(steps[4]), tokenizer)


def test_run_gives_the_same_rows(spark, steps):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls, empty texts, repeated rows, extra columns of any name and an empty table go through; the extra columns stay as they are."""
    extra = ["_row", "__copy", "__times", "key", "kept", "fp", "taken", "doc", "number", "copies", "_same", "stays", "more"]
    rows = [(None, None, None, None, 0)] * 2 + [(1, "", "en", "a", 0), (2, "one two", "en", "a", 7)] + [(3, "w " * 30, None, "b", 60)] * 3
    rows = [(*r, *(f"{name} {i}" for name in extra)) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in extra)
    for name, table in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], table).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            assert {tuple(r) for r in docs.collect()} <= {*given}
        found = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in found} <= {2, 3} and bool(found) == bool(given)
