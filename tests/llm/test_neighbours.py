from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fretwork.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<double>, score string, t int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def exact(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(scored, 1)]
    return out


def result(spark, rows, asked, k, **kwargs):
    found = nb.nearest(frame(spark, rows), frame(spark, asked), k, **kwargs).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def clusters(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, dim)) * 3
    return [(i, (centres[i % len(centres)] + rng.normal(size=dim)).tolist()) for i in range(n)]


def recall(got, want):
    return len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) / len(want)


def test_all_probes_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(nb, "SHARD_ROWS", 40)
    monkeypatch.setattr(nb, "QUERY_ROWS", 7)
    monkeypatch.setattr(nb, "CELL", 50.0)  # one cell holds nearly all, so every shard is cut
    rows = clusters(400)
    asked = rows[::20]
    got, want = result(spark, rows, asked, 5), sorted(exact(rows, asked, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))


def test_recall_on_clusters(spark):
    rows = clusters(2000)
    asked = rows[::20]
    assert recall(result(spark, rows, asked, 10), exact(rows, asked, 10)) >= 0.9


def test_probe_order_is_by_success():
    hashes = nb.Hashes(8, 2.0, tables=1, width=4)
    vector = np.random.default_rng(3).normal(size=(1, 8))
    bucket, inside = hashes.place(vector, 0)
    got = hashes.probes(bucket[0], inside[0], 0, 81)
    assert got[0] == bucket[0] and len(set(got.tolist())) == 81
    import itertools

    costs = {}
    for moves in itertools.product((-1, 0, 1), repeat=4):
        cost = sum({-1: x * x, 0: 0.0, 1: (2.0 - x) ** 2}[m] for m, x in zip(moves, inside[0], strict=True))
        costs[int(bucket[0] + (np.array(moves) * hashes.factors[0]).sum())] = cost
    assert np.all(np.diff([costs[int(b)] for b in got]) >= 0)


def test_rules(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in (5, 3, 4, 8)] + [(1, [0.0, 0.0, 0.0]), (2, None), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0])]
    rows += [(9, [float("inf"), 1.0, 0.0]), (10, [1.0, 2.0]), (None, one), (11, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [])]
    got = result(spark, rows, [r for r in rows if r[0] in (5, 1, 2, 11)], 3)
    root = math.sqrt(2)
    assert got == [(5, 1, 3, 0.0), (5, 2, 4, 0.0), (5, 3, 8, 0.0), (11, 1, 3, root), (11, 2, 4, root), (11, 3, 5, root)]
    assert result(spark, rows, rows[:1], 10) == [(5, 1, 3, 0.0), (5, 2, 4, 0.0), (5, 3, 8, 0.0), (5, 4, 11, root)]
    assert result(spark, [], [], 3) == [] and result(spark, [(1, None)], [(1, None)], 3) == []
    assert result(spark, [(1, one)], [(1, one)], 3) == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).toPandas()
    matrix, ids = np.stack(rows["e"].to_list()), rows["vec_id"].to_numpy()
    want = []
    for at in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(((matrix - matrix[at]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, score)) if i != at][:10]
        want += [(int(ids[at]), r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nb.query(spark, path).collect()]
    assert len(got) == len(want)
    assert recall(got, want) >= 0.9, recall(got, want)
