"""Shards by a consistent-hash ring with bounded loads.

Every shard has ``VIRTUAL`` points on a ring of hashes. A key goes clockwise to the next point; where that shard is full it
continues clockwise to the next shard that is not. The bound of a shard is its even share of all rows, so the counts of
any two shards differ by one at most (law ``rows``). When a shard is added, keys move to it, and others only as far as
the bounds shift.

Keys are inserted in a fixed random order of ``ROUNDS`` rounds and, within a round, by arcs between two points. All keys of an
arc see the same shards in the same order, so only the number of keys per round and arc matters: shards times ``VIRTUAL``
times ``ROUNDS`` counts, whatever the size of the table. From them follows which stretch of each group goes where; each
row finds its stretch by its rank in its group. The ranks of the rows that share a key (rows of equal doc_id and text) are in
one group; all others are dealt out evenly by hash.

Nulls and ties: a null doc_id is a key as any other; its rows are told apart by text. A null text has no bytes, so its size is
that of the row alone. Rows that repeat are separate rows with a slot each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretwork.llm.common import prepare, table
from fretwork.session import materialize

SHARDS = 40
VIRTUAL = 64
ROUNDS = 16
ROW_BYTES = 16
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all points in ascending order, and the shard of each. A shard's points depend on its number alone."""
    number = np.arange(shards * virtual, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (number + np.uint64(1)) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        x ^= x >> np.uint64(31)
    at = x.view(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], (number // np.uint64(virtual)).astype(np.int64)[order]


def clockwise(owners: np.ndarray, shards: int) -> np.ndarray:
    """Per arc the shards in the order in which they are met from its end on."""
    n = len(owners)
    out = np.empty((n, shards), np.int64)
    for arc in range(n):
        _, first = np.unique(np.concatenate((owners[arc:], owners[:arc])), return_index=True)
        out[arc] = np.argsort(first)
    return out


def stretches(counts: pd.DataFrame, shards: int, virtual: int = VIRTUAL) -> pd.DataFrame:
    """(round, arc, first, last, shard, base): rows of rank first to last of a group go to ``shard``, from slot ``base`` on."""
    room = np.full(shards, int(counts["n"].sum()) // shards)
    room[: int(counts["n"].sum()) % shards] += 1
    used = np.zeros(shards, np.int64)
    paths = clockwise(ring(shards, virtual)[1], shards)
    out = []
    for group in counts.sort_values(["round", "arc"]).itertuples(index=False):
        done, n = 0, int(group.n)
        for shard in paths[group.arc]:
            fits = min(n - done, room[shard] - used[shard])
            if fits:
                out.append((group.round, group.arc, done, done + fits - 1, shard, used[shard]))
                used[shard] += fits
                done += fits
            if done == n:
                break
    return pd.DataFrame(out, columns=["round", "arc", "first", "last", "shard", "base"], dtype=np.int64)


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    points = spark.sparkContext.broadcast(ring(shards, virtual)[0])

    @F.pandas_udf("int")
    def arc_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points.value, keys.to_numpy(np.int64)) % len(points.value))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_text"),
        F.xxhash64("doc_id").alias("_key"),
    )
    turn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "_text"), F.lit(ROUNDS)).cast("int")
    rows = materialize(rows.withColumn("round", turn).withColumn("arc", arc_of("_key")), "shard-keys")
    plan = stretches(rows.groupBy("round", "arc").agg(F.count(F.lit(1)).alias("n")).toPandas(), shards, virtual)
    plan = spark.createDataFrame(plan, "round int, arc int, first long, last long, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("round", "arc").orderBy("_key", "doc_id", "_text", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    # A group has as many stretches as shards at most, and nearly always one.
    parts = plan.groupBy("round", "arc").agg(F.collect_list(F.struct("first", "last", "shard", "base")).alias("parts"))
    both = ranked.join(F.broadcast(parts), ["round", "arc"])
    part = F.get(F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (p["last"] >= F.col("rank"))), F.lit(0))
    both = both.withColumn("part", part)
    return both.select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.base") + F.col("rank") - F.col("part.first")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
