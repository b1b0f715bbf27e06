"""Approximate nearest neighbours by p-stable hashing with several probes per table.

A table hashes a vector to ``WIDTH`` integers, floor((a.v + b) / w) with Gaussian a: close vectors get the same or neighbouring
integers. Per table a query visits its own bucket and buckets with some integers one up or down, in the order of their
estimated success, the sum of the squared distances to the boundaries that are crossed; the first ``PROBES`` are visited. The
candidates of all tables are merged and ranked by their exact distance.

The cell width w is ``CELL`` times the median distance to the k-th neighbour within a sample of at most ``SAMPLE`` rows. All
rows are indexed. Each index row travels once per table, with its vector, to the shard of its bucket; a query travels
to the shards of its probes. Shards hold about ``SHARD_ROWS`` rows; fuller ones (hot buckets) are cut into pieces, and their
queries into blocks, so no task holds more. Each shard answers with its ``k`` best per query.

A query that finds fewer than ``k`` candidates, which happens in small tables, is compared with all rows of one table.

Nulls and ties: vectors that are null, zero, or hold null or non-finite components, and those of another than the sample's
most frequent dimension, take no part, nor do rows without vec_id. Of several rows with one vec_id the least vector
counts. Equal distances go to the smaller vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.functions.ranking import top_k
from fretwork.llm.common import partitions, prepare, table
from fretwork.session import materialize

TABLES = 8
WIDTH = 10
PROBES = 300
CELL = 2.0
SAMPLE = 2000
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
SEED = 9


class Hashes:
    """The hash functions of all tables."""

    def __init__(self, dimension: int, cell: float, tables: int = TABLES, width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables, self.width, self.cell = tables, width, cell
        self.directions = rng.normal(size=(tables, dimension, width))
        self.shifts = rng.uniform(0, cell, (tables, width))
        self.factors = rng.integers(-(1 << 62), 1 << 62, (tables, width)) * 2 + 1
        # All ways to move each integer down, not at all, or up: what that adds to the hash of a bucket.
        self.steps = np.zeros((tables, 1), np.int64)
        for i in range(width):
            moves = np.array([-1, 0, 1]) * self.factors[:, i, None]
            self.steps = (self.steps[:, :, None] + moves[:, None, :]).reshape(tables, -1)

    def place(self, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each vector in table ``t``, and its place inside the cell per integer."""
        at = vectors @ self.directions[t] + self.shifts[t]
        whole = np.floor(at / self.cell)
        return (whole.astype(np.int64) * self.factors[t]).sum(axis=1), at - whole * self.cell

    def probes(self, bucket: int, inside: np.ndarray, t: int, n: int) -> np.ndarray:
        """The ``n`` buckets most likely to hold neighbours, the likeliest first."""
        cost = np.zeros(1)
        for x in inside:
            cost = (cost[:, None] + np.array([x * x, 0.0, (self.cell - x) ** 2])).ravel()
        n = min(n, len(cost))
        first = np.argpartition(cost, n - 1)[:n]
        return bucket + self.steps[t][first[np.lexsort((first, cost[first]))]]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def valid(vectors: DataFrame) -> DataFrame:
    """One (vec_id, embedding) per id, all components finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & some)
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE) -> Hashes | None:
    """Hash functions for ``vectors`` as returned by ``valid``; None where there are none."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(rows):
        return None
    dimension = int(rows["embedding"].map(len).mode().iloc[0])
    drawn = np.stack([v for v in rows["embedding"] if len(v) == dimension]).astype(np.float64)
    squares = (drawn * drawn).sum(axis=1)
    distances = np.sqrt(np.maximum(squares[:, None] + squares - 2 * drawn @ drawn.T, 0))
    distances.sort(axis=1)
    near = float(np.median(distances[:, min(k, len(drawn) - 1)])) or float(np.sqrt(squares).mean())
    return Hashes(dimension, CELL * near)


def _index(vectors: DataFrame, hashes, shards: int) -> DataFrame:
    """(t, shard, bucket, vec_id, embedding): every vector once per table."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hashes.value
        for batch in batches:
            matrix = _matrix(batch.column("embedding"), own.directions.shape[1])
            for t in range(own.tables):
                bucket = own.place(matrix, t)[0]
                n = len(bucket)
                columns = [pa.array(np.full(n, t)), pa.array(bucket % shards), pa.array(bucket), batch.column("vec_id"), batch.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, ["t", "shard", "bucket", "vec_id", "embedding"])

    return vectors.mapInArrow(run, f"t long, shard long, bucket long, vec_id long, embedding {kind}")


def _asked(queries: DataFrame, hashes, shards: int, n_probes: int) -> DataFrame:
    """(t, shard, query_id, asked, buckets): the buckets that a query visits, by shard."""
    kind = queries.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hashes.value
        for batch in batches:
            matrix = _matrix(batch.column("embedding"), own.directions.shape[1])
            for t in range(own.tables):
                buckets, inside = own.place(matrix, t)
                rows, shard, lists = [], [], []
                for i, (bucket, x) in enumerate(zip(buckets, inside, strict=True)):
                    found = own.probes(bucket, x, t, n_probes)
                    home = found % shards
                    for s in np.unique(home):
                        rows.append(i)
                        shard.append(s)
                        lists.append(found[home == s])
                ids, vectors = batch.column("vec_id").take(pa.array(rows)), batch.column("embedding").take(pa.array(rows))
                columns = [pa.array(np.full(len(rows), t)), pa.array(shard, pa.int64()), ids, vectors, pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["t", "shard", "query_id", "asked", "buckets"])

    return queries.mapInArrow(run, f"t long, shard long, query_id long, asked {kind}, buckets array<long>")


def _best(index: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of one piece for each query of one block; a query without buckets sees all rows."""
    out = []
    if len(index) and len(asked):
        index = index.sort_values("bucket", kind="stable")
        matrix, ids = np.stack(index["embedding"].to_list()).astype(np.float64), index["vec_id"].to_numpy()
        buckets, first, counts = np.unique(index["bucket"].to_numpy(), return_index=True, return_counts=True)
        for query_id, vector, visits in zip(asked["query_id"], asked["asked"], asked["buckets"], strict=True):
            if visits is None:
                rows = np.arange(len(ids))
            else:
                at = np.minimum(np.searchsorted(buckets, visits), len(buckets) - 1)
                at = at[buckets[at] == visits]
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[i], first[i] + counts[i]) for i in at)])
            rows = rows[ids[rows] != query_id]
            if not len(rows):
                continue
            score = np.sqrt(((matrix[rows] - np.asarray(vector, np.float64)) ** 2).sum(axis=1))
            if len(rows) > k:
                near = score <= np.partition(score, k - 1)[k - 1]
                rows, score = rows[near], score[near]
            order = np.lexsort((ids[rows], score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows][order], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _answers(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every shard that a query visits."""
    rows = index.groupBy("t", "shard").agg(F.count(F.lit(1)).alias("n"))
    questions = asked.groupBy("t", "shard").agg(F.count(F.lit(1)).alias("q"))
    layout = rows.join(questions, ["t", "shard"]).select(
        "t", "shard", F.ceil(F.col("n") / (2 * SHARD_ROWS)).alias("pieces"), F.ceil(F.col("q") / QUERY_ROWS).alias("blocks")
    )
    layout = materialize(layout, "neighbour-layout")
    stored = index.join(layout, ["t", "shard"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    stored = stored.select("t", "shard", "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "bucket", "vec_id", "embedding")
    posed = asked.join(layout, ["t", "shard"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    posed = posed.select("t", "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "block", "query_id", "asked", "buckets")
    key = ["t", "shard", "piece", "block"]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return _best(one, two, k)

    return stored.groupBy(*key).cogroup(posed.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, n_probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, embedding) its nearest rows of ``vectors``, itself excepted."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialize(valid(vectors), "neighbour-vectors")
    hashes = fit(rows, k)
    result = "query_id long, rank int, vec_id long, score double"
    if hashes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("embedding") == hashes.directions.shape[1])
    total = rows.count()
    shards = -(-total // SHARD_ROWS)
    shared = spark.sparkContext.broadcast(hashes)
    index = materialize(_index(rows, shared, shards), "neighbour-index")
    # Few rows, but thousands of possible probes each: as many tasks as there are partitions.
    questions = valid(queries).where(F.size("embedding") == hashes.directions.shape[1]).repartition(partitions(spark), "vec_id")
    asked = materialize(_asked(questions, shared, shards, n_probes), "neighbour-queries")
    hits = materialize(_answers(index, asked, k), "neighbour-hits")

    found = hits.groupBy("query_id").agg(F.count_distinct("vec_id").alias("found"))
    short = questions.join(found, questions["vec_id"] == found["query_id"], "left")
    short = short.where(F.coalesce("found", F.lit(0)) < min(k, total - 1)).select("vec_id", "embedding")
    everywhere = index.where("t = 0").select("t", "shard").distinct()
    again = short.withColumn("t", F.lit(0).cast("long")).join(everywhere, "t")
    again = again.select("t", "shard", F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), F.lit(None).cast("array<long>").alias("buckets"))
    if not short.isEmpty():
        hits = hits.unionByName(_answers(index.where("t = 0"), materialize(again, "neighbour-short"), k))

    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return top_k(best, ["query_id"], [F.col("score"), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)
