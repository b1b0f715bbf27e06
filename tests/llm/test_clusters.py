from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from oracle import connect, difference

from fretwork.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=16, rounds=3, dimension=64, scale=64):
    kept = [(i, [max(min(math.floor(scale * x), clusters.LIMIT), -clusters.LIMIT) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), at) for at, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, at in found if at == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = clusters.LARGEST
    return sorted([(i, at, d, min(inertia[at], most), min(sum(inertia), most), digest[at]) for (i, _), (d, at) in zip(kept, found, strict=True)], key=str)


def result(spark, tmp_path, rows, schema=SCHEMA):
    folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(map(tuple, clusters.query(spark, str(folder)).collect()), key=str)


def vectors(n, centres=20, seed=5):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middle)]) for i in range(n)]


def test_clustered_vectors(spark, tmp_path):
    rows = vectors(300)
    assert result(spark, tmp_path, rows) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    inf, nan = math.inf, math.nan
    rows = vectors(30)
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [nan] + [1.0] * 63), (106, [-inf] + [1.0] * 63)]
    rows += [(107, [0.0] * 64)] * 3 + [(None, [0.5] * 64)] * 2 + [(7, [-0.001] * 64), (108, [1e300] * 64), (109, [-1e300] * 64)]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows)
    assert len(got) == 38 and all(r[2] >= 0 and r[3] >= 0 for r in got)


def test_ties_few_and_none(spark, tmp_path):
    same = [(i, [0.25] * 64) for i in range(40)]
    assert result(spark, tmp_path, same) == brute(same)
    two = vectors(2)
    assert result(spark, tmp_path, two) == brute(two)
    assert result(spark, tmp_path, []) == []
    wide = [(*r, 1, "x") for r in vectors(20)]
    assert result(spark, tmp_path, wide, f"{SCHEMA}, cluster int, distance string") == brute([r[:2] for r in wide])


def test_pivots_save_distances_and_lose_nothing(spark):
    rows = spark.createDataFrame(vectors(2000), SCHEMA)
    _, centroids, measured = clusters.clustered(rows)
    assert len(measured) == 3 and max(measured) < 0.4 * 2000 * len(centroids)


def test_bounds_with_large_components():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-clusters.LIMIT, clusters.LIMIT, (400, 64))
    matrix[200:] = matrix[:200] + rng.integers(-1, 2, (200, 64))
    centroids, pivots = matrix[:16], matrix[16:28]
    far = np.stack([clusters.squares(matrix, p) for p in pivots], axis=1)
    cluster, distance, _ = clusters.nearest_centroid(matrix, far, centroids, pivots)
    every = np.stack([clusters.squares(matrix, c) for c in centroids], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(clusters.query(spark, sf), connect(sf), clusters.SQL) is None
