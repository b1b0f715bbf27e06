"""Centroid clustering in exact integers, with a pivot table (LAESA) that saves most distances.

Vectors become integers, floor(scale * x) per component. The first ``k`` by a seeded hash of their ids are the centroids. A round
assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each
centroid to the floor of its vectors' mean; a centroid without vectors stays.

Pivot table: ``PIVOTS`` vectors far from each other, found in a sample of at most ``SAMPLE`` rows, are fixed. The integer distances of
every vector to them are stored once, beside the vector. In each round the centroids' distances to the pivots are new, and the
largest difference of the two is a lower bound of the distance from vector to centroid. The centroid of the smallest bound is
measured first; the others are measured only where their bound does not exceed the best distance so far. Bounds are lowered
by more than the rounding of floating point can add, and what is measured is measured in integers, so the result is that of
comparing all pairs, also for ties.

A round is one scan: each task sends one row of sums per centroid, and ``k`` rows come to the driver. Vectors never move.

Nulls and ties: a vector takes part if it has exactly ``dimension`` components, none null or non-finite. Repeated rows and ids
count as often as they stand; a vector without vec_id can be no first centroid before those that have one. Integers beyond
+-2^27 are set to that bound, which keeps every distance within 63 bits; sums that are larger than a long are given as the largest
long. Other columns are not read. With fewer than ``k`` vectors there are fewer centroids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import prepare, table
from fretwork.session import materialize

K = 16
ROUNDS = 3
SCALE = 64
DIMENSION = 64
SEED = 1
PIVOTS = 12
SAMPLE = 1024
LIMIT = 1 << 27
LARGEST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimension) & fine)
    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def squares(matrix: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one integer point."""
    away = matrix - point
    return np.einsum("ij,ij->i", away, away)


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the farthest from those before it; fewer where no further row differs."""
    chosen, near = [0], squares(sample, sample[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(sample, sample[chosen[-1]]))
    return sample[chosen]


def _rows(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, far): ``rows`` with their squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                matrix = _rows(batch.column("v"))
                far = np.stack([squares(matrix, p) for p in pivots], axis=1)
                offsets = pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, far.ravel())], ["vec_id", "v", "far"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, v array<int>, far array<long>")


def nearest_centroid(matrix: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row, the squared distance to it, and how many distances were measured."""
    to_pivots = np.sqrt(np.stack([squares(centroids, p) for p in pivots], axis=1).astype(np.float64))
    roots = np.sqrt(far.astype(np.float64))
    bound = np.zeros((len(matrix), len(centroids)))
    for p in range(len(pivots)):
        one, two = roots[:, p, None], to_pivots[None, :, p]
        np.maximum(bound, np.abs(one - two) - (one + two) * 1e-15, out=bound)
    bound = bound * bound * (1 - 1e-14)
    cluster = bound.argmin(axis=1)
    away = matrix - centroids[cluster]
    best, measured, first = np.einsum("ij,ij->i", away, away), len(matrix), cluster.copy()
    for c, centroid in enumerate(centroids):
        open_rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        found = squares(matrix[open_rows], centroid)
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (c < cluster[open_rows]))
        best[open_rows[better]], cluster[open_rows[better]] = found[better], c
        measured += len(open_rows)
    return cluster, best, measured


def partial_sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(cluster, n, measured, sums): a row per task and centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, measured = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                matrix = _rows(batch.column("v"))
                cluster, _, n = nearest_centroid(matrix, _rows(batch.column("far")), centroids, pivots)
                np.add.at(sums, cluster, matrix)
                counts += np.bincount(cluster, minlength=len(centroids))
                measured[0] += n
        columns = [pa.array(np.arange(len(centroids))), pa.array(counts), pa.array(measured), pa.array(sums.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "measured", "sums"])

    return stored.mapInArrow(run, "cluster long, n long, measured long, sums array<long>")


def assigned(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cluster, distance, _ = nearest_centroid(_rows(batch.column("v")), _rows(batch.column("far")), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = stored.schema["vec_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and the number of distances that were measured."""
    wide = F.sum(F.col("x").cast("decimal(38,0)")).alias("sum")
    partial = partial_sums(stored, centroids, pivots)
    parts = partial.select("cluster", F.posexplode(F.concat("sums", F.array("n", "measured"))).alias("i", "x"))
    totals = {(r["cluster"], r["i"]): int(r["sum"]) for r in parts.groupBy("cluster", "i").agg(wide).collect()}
    width = centroids.shape[1]
    new = centroids.copy()
    for c in range(len(centroids)):
        n = totals.get((c, width), 0)
        if n:
            new[c] = [totals[c, i] // n for i in range(width)]
    return new, sum(totals.get((c, width + 1), 0) for c in range(len(centroids)))


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) per vector, the centroids, and the distances measured in each round, where all pairs would be rows times ``k``."""
    prepare(vectors.sparkSession)
    rows = integer_vectors(vectors, dimension, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(drawn.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        none = vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")
        return none, np.zeros((0, dimension), np.int64), []
    centroids = np.array([r["v"] for r in first], np.int64)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "v").limit(SAMPLE).select("v").collect()
    pivots = far_apart(np.array([r["v"] for r in sample], np.int64), PIVOTS)
    stored = materialize(pivot_table(rows, pivots), "cluster-pivots")
    measured = []
    for _ in range(rounds):
        centroids, n = moved(stored, centroids, pivots)
        measured.append(n)
    return assigned(stored, centroids, pivots), centroids, measured


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, _ = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = materialize(rows, "clusters")
    sums = {r["cluster"]: int(r["sum"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    total = min(sum(sums.values()), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, min(sums.get(c, 0), LARGEST), total, digest) for c, digest in enumerate(digests)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Every distance in every round; the exact floor of a negative mean needs the remainder."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"a{i} AS (SELECT row, min({{'d': d, 'k': k}}) AS best FROM (SELECT row, k, "
            f"list_sum(list_transform(range(1, {DIMENSION + 1}), lambda i: (v.c[i] - m.c[i]) * (v.c[i] - m.c[i]))) AS d FROM v CROSS JOIN m{i} m) GROUP BY row)"
        )
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT best.k AS k, i, sum(c[i]) AS s, count(*) AS n FROM v JOIN a{i} USING (row), range(1, {DIMENSION + 1}) r(i) GROUP BY best.k, i)")
            steps.append(f"n{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY k)")
            steps.append(f"m{i + 1} AS (SELECT k, coalesce(n{i}.c, m{i}.c) AS c FROM m{i} LEFT JOIN n{i} USING (k))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}
), m0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, c) - 1 AS k, c FROM v QUALIFY k < {K}
), {", ".join(steps)}
SELECT vec_id, best.k::INT AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (row) JOIN m{ROUNDS} m ON m.k = best.k
"""


SQL = _sql()
