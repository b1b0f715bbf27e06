"""Exact nearest texts by inverted lists over weighted terms.

A query walks the lists of its terms, the term first that covers most of the query for the length of its list, and scores each
item of a list that it has not met. What the lists still to come can add up to is bounded by the largest weight of each list, and by
the length of the query's vector over their terms, since an item's is at most one; once that is below the query's k-th similarity,
no unmet item can be among the nearest and the rest is skipped. The result is that of all pairs.

Items of equal vectors are searched once, as a class that stands for its ``k`` smallest ids and counts that often for the k-th
similarity. Each member has the nearest items of its class.

Both sides are cut into blocks. A query block first searches one item block, which gives each of its queries a k-th similarity
to start with in all the others. A pair of blocks holds ``MAX_BLOCK_BYTES`` of item weights and hands on ``k`` items per query.

Items without id or without terms take no part. Ties go to the smaller id. An item's rows must name each bucket once. Fewer
items than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.functions.blocks import DIGITS
from fretwork.functions.ranking import top_k
from fretwork.session import materialize

MAX_BLOCK_BYTES = 32 * 1024 * 1024
# Queries of a block, about, as long as that makes no more blocks than there are shuffle partitions.
BLOCK_QUERIES = 2048
# Sums of products in another order differ by less than this.
SLACK = 1e-9
VECTOR = ["terms", "weights"]


class _Lists:
    """Inverted lists over one block of items."""

    def __init__(self, items: pd.DataFrame):
        sizes = items["terms"].map(len).to_numpy()
        rows = np.repeat(np.arange(len(items)), sizes)
        weights = np.concatenate([_unit(w) for w in items["weights"]])
        self.ids = items["item_id"].to_numpy(dtype=object)
        self.copies = items["ids"].map(len).to_numpy()
        self.used, column = np.unique(np.concatenate(items["terms"].to_list()), return_inverse=True)
        # A row per item: its terms and weights, filled up with weights of zero.
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.columns, self.weights = np.zeros((len(items), sizes.max()), np.int32), np.zeros((len(items), sizes.max()))
        self.columns[rows, place], self.weights[rows, place] = column, weights
        order = np.argsort(column, kind="stable")
        self.lengths = np.bincount(column, minlength=len(self.used))
        ends = np.cumsum(self.lengths)
        self.lists = np.split(rows[order], ends[:-1])
        self.largest = np.maximum.reduceat(weights[order], np.concatenate(([0], ends[:-1])))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int, float]:
        """Numbers and similarities of the best ``k`` classes that reach ``least``, how many were scored, and what the k-th item reaches."""
        at = np.minimum(np.searchsorted(self.used, terms), len(self.used) - 1)
        known = self.used[at] == terms
        columns, share = at[known], weights[known]
        adds = share * self.largest[columns]
        order = np.argsort(-share * share / self.lengths[columns], kind="stable")
        # Before each list: the most that it and those after it can add to a similarity.
        rest = [np.cumsum(x[order][::-1])[::-1] for x in (adds, share * share)]
        rest = np.minimum(rest[0], np.sqrt(rest[1]))
        query = np.zeros(len(self.used))
        query[columns] = share
        unmet = np.ones(len(self.ids), bool)
        found, sims, floor = [], [], least
        best = np.empty(0)
        for i, most in zip(order, rest, strict=True):
            if most < floor - SLACK:
                break
            new = self.lists[columns[i]]
            new = new[unmet[new]]
            unmet[new] = False
            pairs = query.take(self.columns.take(new, axis=0)), self.weights.take(new, axis=0)
            values = np.round(np.einsum("ij,ij->i", *pairs), DIGITS)
            near = values >= floor
            found.append(new[near])
            sims.append(values[near])
            best = np.concatenate([best, np.repeat(values[near], self.copies[new[near]])])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[-k:]
                floor = max(floor, best.min())
        if floor <= SLACK:
            # What shares no term is as far as can be, yet there are no k nearer ones.
            found.append(np.flatnonzero(unmet))
            sims.append(np.zeros(int(unmet.sum())))
            unmet[:] = False
        numbers, values = np.concatenate([np.empty(0, np.int64), *found]), np.concatenate([np.empty(0), *sims])
        near = values >= floor
        numbers, values = numbers[near], values[near]
        first = np.lexsort((self.ids[numbers], -values))[:k]
        return numbers[first], values[first], int((~unmet).sum()), floor


def _unit(weights) -> np.ndarray:
    values = np.asarray(weights, np.float64)
    return values / np.linalg.norm(values)


def _search_blocks(items: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """Hits of every pair of blocks, and per query and item block a row without item: how many were scored, and the similarity reached."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries, found, sims, scored = [], [], [], []
        if len(left) and len(right):
            lists = _Lists(left)
            for query, terms, weights, least in zip(right["query_id"], right["asked"], right["shares"], right["least"], strict=True):
                numbers, values, n, floor = lists.nearest(np.asarray(terms), _unit(weights), k, -2.0 if pd.isna(least) else least)
                queries += [query] * (len(numbers) + 1)
                found += [*lists.ids[numbers], None]
                sims += [*values, floor]
                scored += [None] * len(numbers) + [n]
        columns = {"query_id": queries, "item_id": found, "similarity": sims, "scored": scored}
        out = pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in columns.items()})
        return out.astype({"similarity": "float64", "scored": "Int64"})

    keys = ["item_block", "query_block"]
    return items.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, schema)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(item_id, terms, weights, ids) per vector: ``ids`` are the ``k`` smallest of those that share it, ``item_id`` the first of them."""
    first = top_k(rows, VECTOR, [F.col("item_id")], k)
    ids = first.groupBy(*VECTOR).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    return ids.select(F.element_at("ids", 1).alias("item_id"), *VECTOR, "ids")


def nearest_by_terms(
    weights: DataFrame, k: int, buckets: int, max_bytes: int = MAX_BLOCK_BYTES, block_queries: int = BLOCK_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest items of every item by cosine, itself included, and the cost.

    ``weights``: item_id, bucket (below ``buckets``), weight above zero. Returns (query_id, rank, item_id, similarity), and
    (query_id, scored): with how many classes of items each query was compared.
    """
    spark = weights.sparkSession
    entry = F.struct("bucket", F.col("weight").cast("float").alias("weight"))
    rows = weights.where("item_id is not null").groupBy("item_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    rows = materialize(rows.select("item_id", F.col("e.bucket").alias("terms"), F.col("e.weight").alias("weights")), "term-vectors")
    classes = materialize(_classes(rows, k), "term-classes")
    kind = rows.schema["item_id"].dataType.simpleString()
    schema = f"query_id {kind}, item_id {kind}, similarity double, scored long"
    n = classes.count()
    n_items = max(1, -(-n * buckets * 8 // max_bytes))
    n_queries = max(n_items, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_queries)))

    def dealt(own: bool, least: DataFrame | None) -> DataFrame:
        """Hits of the pairs of blocks that are (not) each query's own pair."""
        hashed = F.xxhash64("item_id")
        item_block, query_block = F.pmod(hashed, F.lit(n_items)), F.pmod(hashed, F.lit(n_queries))
        blocks = {side: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")) for side, count in (("i", n_items), ("q", n_queries))}
        together = F.col("query_block") % n_items == F.col("item_block")
        chosen = together if own else ~together
        items = classes.select("*", item_block.alias("item_block"), blocks["q"].alias("query_block")).where(chosen)
        asked = classes.select(F.col("item_id").alias("query_id"), F.col("terms").alias("asked"), F.col("weights").alias("shares"), query_block.alias("query_block"))
        asked = asked.withColumn("least", F.lit(None).cast("double")) if least is None else asked.join(least, "query_id", "left")
        return _search_blocks(items, asked.withColumn("item_block", blocks["i"]).where(chosen), k, schema)

    order = [F.col("similarity").desc(), F.col("item_id")]
    hits = materialize(dealt(True, None), "own-blocks")
    if n_items > 1:
        reached = hits.where("item_id is null").select("query_id", F.col("similarity").alias("least"))
        hits = hits.unionByName(materialize(dealt(False, reached), "other-blocks"))
    # An item of the k nearest stands in one of the k nearest classes, by similarity and first id.
    best = top_k(hits.where("item_id is not null"), ["query_id"], order, k).select("query_id", "item_id", "similarity")
    best = best.join(classes.select("item_id", "ids"), "item_id").select("query_id", "similarity", F.explode("ids").alias("item_id"))
    best = top_k(best, ["query_id"], order, k).groupBy("query_id").agg(F.collect_list(F.struct("rank", "item_id", "similarity")).alias("near"))
    found = best.join(hits.groupBy("query_id").agg(F.sum("scored").alias("scored")), "query_id").withColumnRenamed("query_id", "class_id")
    members = rows.join(classes.select(F.col("item_id").alias("class_id"), *VECTOR), VECTOR).select(F.col("item_id").alias("query_id"), "class_id")
    found = members.join(found, "class_id")
    return found.select("query_id", F.inline("near")), found.select("query_id", "scored")
