from __future__ import annotations

import math
import os
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from oracle import connect
from pyspark.sql import functions as F

from fretwork.llm import quality
from fretwork.llm.common import kth_largest, spread, word_hashes

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def test_word_hashes_are_a_function_of_the_word():
    texts = ["The cat, the CAT", None, "", " \n\t ", "cat, été", "x" * 300000 + " the", "the"]
    hashes, counts = word_hashes(texts, block=20)
    names = [w for t in texts for w in words_of(t)]
    assert list(counts) == [len(words_of(t)) for t in texts]
    seen = {}
    for name, value in zip(names, hashes, strict=True):
        assert seen.setdefault(name, value) == value
    assert len(set(seen.values())) == len(seen)


def plain_grams(text, bits):
    own = [word_hashes([w])[0][0] for w in words_of(text)]
    with np.errstate(over="ignore"):
        pairs = [a * np.uint64(0xD6E8FEB86659FD93) + b for a, b in zip(own, own[1:], strict=False)]
    return [int(x) for x in spread(np.array(own + pairs, np.uint64), bits)]


def plain_weights(docs, good, bits):
    raw, target = [0] * (1 << bits), [0] * (1 << bits)
    for doc, text in docs:
        for g in plain_grams(text, bits):
            raw[g] += 1
            target[g] += doc in good
    share = sum(target) / sum(raw)
    ratio = [math.log(t + 1) - math.log(r * share + 1) for t, r in zip(target, raw, strict=True)]
    return {doc: 1000 * sum(ratio[g] for g in plain_grams(t, bits)) / max(1, len(plain_grams(t, bits))) for doc, t in docs}


def test_weights_and_sample_by_hand(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefgh" if i % 3 else "hijklmnop", k=rng.randrange(0, 40)))) for i in range(120)]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)] + [(5, None, 1), (6, 1, 0), (None, 1, 0), (4, 1, None)]
    good = {i for i in range(60) if i % 3 and i % 7}
    rows = quality.score(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=10,
    ).collect()
    want = plain_weights(docs, good, 10)
    assert all(abs(1000 * r.mean_ratio - want[r.doc_id]) < 0.01 for r in rows)
    slope = quality.fitted_slope(*(np.array(x, float) for x in zip(*[(want[i] / 1000, i % 3 > 0) for i in range(60)], strict=True)))
    assert all(abs(r.log_weight - slope * r.mean_ratio) < 0.01 for r in rows) and 1 < slope < 1000
    k = round(40 / 60 * 120)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in sorted(rows, key=lambda r: -r.key)[:k]}
    noise = [r.key - r.log_weight for r in rows]
    assert 0.2 < sum(noise) / len(noise) < 1.0 and len(set(noise)) > 100


def test_a_batch_is_worked_off_in_slices(monkeypatch):
    """The n-grams of a batch of 8 MB do not stand in memory at once, and slices give the same numbers."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghij", k=2000)) for _ in range(2000)] + [None, "", "x", "a b " * 100_000]
    frame = pd.DataFrame({"text": texts, "target": [i % 3 == 0 for i in range(len(texts))]})
    ratios = np.random.default_rng(3).normal(size=1 << 10).astype(np.float32)

    def traced(work):
        work()
        tracemalloc.start()
        result = work()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return result, peak

    (raw, target), counting = traced(lambda: quality.count_grams(iter([frame]), 10))
    means, weighing = traced(lambda: quality.mean_ratios(texts, ratios, 10))
    monkeypatch.setattr(quality, "SLICE", 1 << 40)
    (whole, whole_target), counting_whole = traced(lambda: quality.count_grams(iter([frame]), 10))
    whole_means, weighing_whole = traced(lambda: quality.mean_ratios(texts, ratios, 10))
    assert (raw == whole).all() and (target == whole_target).all() and (means == whole_means).all()
    assert raw.sum() == sum(2 * len(words_of(t)) - 1 for t in texts if words_of(t)) and list(means[-4:-2]) == [0, 0]
    assert 4 * counting < counting_whole and 4 * weighing < weighing_whole


def test_the_draw_follows_the_weights(spark):
    """Over 300 seeds a document is drawn as often as Gumbel top-k by its weight says."""
    weights = [x / 4 for x in range(-20, 20)]
    rows = spark.createDataFrame([(i, 7 * i, w) for i, w in enumerate(weights)], "doc_id long, _row long, w double")
    rows = rows.crossJoin(spark.range(300).withColumnRenamed("id", "seed"))
    keys = rows.select("seed", "doc_id", quality.drawn_keys(F.col("w"), F.col("seed")).alias("key")).toPandas()
    first = keys.sort_values("key", ascending=False).groupby("seed").head(20)
    share = first.groupby("doc_id").size().reindex(range(40), fill_value=0).to_numpy() / 300
    draws = np.random.default_rng(1).gumbel(size=(20_000, 40)) + np.array(weights)
    want = (draws.argsort(axis=1).argsort(axis=1) >= 20).mean(axis=0)
    assert abs(share - want).max() < 0.12 and ((0.1 < share) & (share < 0.9)).sum() > 10


def test_the_slope_is_that_of_the_odds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-(5 * x + 1)))
    assert abs(quality.fitted_slope(x, good.astype(float)) - 5) < 0.3
    assert quality.fitted_slope(np.zeros(3), np.ones(3)) == quality.REFERENCE == quality.fitted_slope(np.zeros(0), np.zeros(0))


def test_edges(spark):
    docs = [(1, "a b", 1.0), (1, "a b", 1.0), (None, None, 2.0), (2, "", 2.0), (3, "bad bad", 0.0), (4, "a " * 100000, 0.0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, log_weight double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.score(docs, none, bits=8).collect())
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, labels, bits=8).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 3 and not min(rows, key=lambda r: r.key).kept
    first = [(r.key, r.kept) for r in rows if r.doc_id == 1]
    assert len(first) == 2 and first[0] == first[1]
    stayed = quality.resample(docs, labels)
    assert stayed.columns == docs.columns
    assert quality.score(docs.limit(0), labels, bits=8).count() == 0


def test_kth_largest(spark):
    values = [random.Random(1).randrange(-(1 << 50), 1 << 50) for _ in range(500)] + [7] * 50
    table = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 100, 275, 550):
        assert kth_largest(table, "x", k) == sorted(values, reverse=True)[k - 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_quality(spark):
    """Fitted without a fifth of the labels, the sample keeps the good of that fifth and rejects the bad."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.kept for r in quality.score(docs, labels.where("doc_id % 5 <> 0")).collect()}
    held = connect(sf).execute("SELECT doc_id, quality FROM labels WHERE doc_id % 5 = 0").fetchall()
    good, bad = [kept[d] for d, q in held if q == 1], [kept[d] for d, q in held if q == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.15
