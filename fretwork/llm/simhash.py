"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits, taken by majority over the XXH64 hashes of the word shingles. Documents whose
fingerprints differ in at most ``radius`` bits are linked, and a component of links is one group.

Search for links: the 64 bits are cut into ``BLOCKS`` blocks. Two linked fingerprints agree in all but ``radius`` of them
at least, so they meet in the shard of some choice of that many blocks: with six blocks and radius 4 each fingerprint is in 15
shards of about 21 common bits. For billions of fingerprints 8 blocks (70 shards of 32 bits) keep the shards small. A shard holds distinct fingerprints that agree
there; its BK-tree keys each child by the integer Hamming distance to its parent, and a search follows only the
edges within the radius of the distance at hand. Shards are dealt out over the tasks. A broadcast of all trees would
grow with the documents; instead each tree goes where the fingerprints that can match it are. A shard above
``PIECE`` fingerprints is cut into pieces and each pair of pieces is one search, so no task holds a large shard.

Nulls and ties: a text that is null or has no words has fingerprint zero and is linked like any other. A null doc_id
counts as a document, but is never the name of a component unless all its members lack one. Rows that repeat
keep their own row of the result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import map_text, one_row_each, partitions, prepare, row_key, table, without
from fretwork.llm.components import connected
from fretwork.session import materialize

SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCKS = 6
PIECE = 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    found = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    found = found.split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _row, fp) per row of ``docs``; fp holds the 64 bits as a signed long."""

    def codes(texts: list) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_row"), "text")
    return map_text(rows, "fp long", codes)


def block_masks(radius: int, n: int = BLOCKS) -> list[int]:
    """Masks over every choice of ``n - radius`` of ``n`` blocks of bits, as signed longs."""
    if n <= radius:
        raise ValueError(f"a radius of {radius} needs more than {n} blocks")
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, n - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shards(codes: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """Members of the shards with two or more fingerprints: (t, code, a, b, in_tree, asks, fp)."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("code")) for t, m in enumerate(block_masks(radius, blocks))]
    keys = codes.select("fp", F.explode(F.array(*tables)).alias("k")).select("k.t", "k.code", "fp")
    shared = keys.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    members = keys.join(shared, ["t", "code"]).withColumn("pieces", pieces)
    members = members.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda q: F.struct(
            F.least("p", q).alias("a"),
            F.greatest("p", q).alias("b"),
            (F.col("p") <= q).alias("in_tree"),
            (F.col("p") >= q).alias("asks"),
        ),
    )
    return members.select("t", "code", "fp", F.explode(pairs).alias("s")).select("t", "code", "s.*", "fp")


class Forest:
    """BK-trees of several shards at once. ``shard`` numbers the shard of each code; codes of a shard differ."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes = codes
        number, first = np.unique(shard, return_index=True)
        self.root = np.full(int(shard.max()) + 1 if len(shard) else 0, -1, np.int64)
        self.root[number] = first
        here = self.root[shard]
        left = np.flatnonzero(here != np.arange(len(codes)))
        keys, children = [], []
        while len(left):
            key = here[left] * 65 + np.bitwise_count(codes[left] ^ codes[here[left]])
            unique, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            children.append(left[first])
            here[left] = left[first][group]
            left = left[here[left] != left]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[order], self.children[order]

    def within(self, asked: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (asked, code) of one shard that differ in at most ``radius`` bits."""
        query = np.flatnonzero((shard < len(self.root)) & (self.root[np.minimum(shard, len(self.root) - 1)] >= 0))
        node = self.root[shard[query]]
        found = [(query[:0], node[:0])]
        while len(query):
            distance = np.bitwise_count(asked[query] ^ self.codes[node]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            width = high - low
            into = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
            query, node = np.repeat(query, width), self.children[into]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _merge(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Smallest index per component, after links (one, two)."""
    while True:
        low = np.minimum(label[one], label[two])
        if (label[one] == low).all() and (label[two] == low).all():
            return label
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        label = label[label]


def _spanning(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of whole shards, reduced to one link from each fingerprint to the first of its local component."""
    keys = frame[["t", "code", "a", "b"]].to_numpy()
    shard = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
    codes = frame["fp"].to_numpy().view(np.uint64)
    tree, asks = np.flatnonzero(frame["in_tree"].to_numpy()), np.flatnonzero(frame["asks"].to_numpy())
    forest = Forest(codes[tree], shard[tree])
    sizes = np.bincount(shard[tree], minlength=shard[-1] + 1)
    cost = np.cumsum(sizes[shard[asks]]) // (1 << 21)
    label = np.arange(len(codes))
    for part in np.split(asks, np.flatnonzero(np.diff(cost)) + 1):
        query, node = forest.within(codes[part], shard[part], radius)
        one, two = part[query], tree[node]
        label = _merge(label, one[one != two], two[one != two])
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return pd.DataFrame({"u": codes[moved].view(np.int64), "v": codes[label[moved]].view(np.int64)})


def links(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints of ``codes`` (fp) within the radius of each other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame.iloc[-1]
            same = (frame["t"] == last.t) & (frame["code"] == last.code) & (frame["a"] == last.a) & (frame["b"] == last.b)
            held = frame[same]
            if not same.all():
                yield _spanning(frame[~same].reset_index(drop=True), radius)
        if held is not None:
            yield _spanning(held.reset_index(drop=True), radius)

    key = ["t", "code", "a", "b"]
    dealt = shards(codes, radius, blocks).repartition(partitions(codes.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInPandas(run, "u long, v long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _row, fp, root, component_id) per row: ``root`` names the group, ``component_id`` its smallest doc_id."""
    prepare(docs.sparkSession)
    marks = materialize(fingerprints(docs, shingle), "simhash-marks")
    codes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-codes")
    found = connected(links(codes, radius), "simhash")
    rooted = codes.join(found, codes["fp"] == found["vertex"], "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.select("fp", "root").join(names, "root"), "simhash-groups")
    return marks.join(named, "fp").select("doc_id", "_row", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row with the smallest doc_id (then row key, then columns)."""
    rows = materialize(groups(docs, shingle, radius), "simhash-rows")
    size = rows.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    # Written out, so that the join has a shuffle of its own on both sides and a large group is split.
    keys = rows.join(materialize(size.where("n > 1"), "simhash-sizes"), "root")
    best = keys["doc_id"].eqNullSafe(keys["best.doc_id"]) & keys["_row"].eqNullSafe(keys["best._row"])
    same = keys.select("doc_id", "_row", best.alias("stays")).groupBy("doc_id", "_row", "stays").agg(F.count(F.lit(1)).alias("rows"))
    same = materialize(same, "simhash-decisions")
    kept = without(docs, same.where("not stays").select("doc_id", "_row"))
    repeated = same.where("stays and rows > 1").select("doc_id", "_row")
    return one_row_each(kept, repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    code = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select("doc_id", code.alias("fingerprint"), "component_id")
