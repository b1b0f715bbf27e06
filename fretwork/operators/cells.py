"""Inverted-file index of vectors: cells around trained centres, compact codes, exact reranking.

``write_index`` trains the centres by spherical k-means on a bounded sample, puts every vector into the cell of its nearest centre
and stores the table by cell: id, an int8 code with its scale, and the vector itself. A search reads only the cells it visits, first
ids and codes alone; the best ``RERANK`` * k of each query by code are compared exactly. How many cells a query must
visit for the wanted recall is measured while the index is written: for some of its own vectors, the rank of the cell that
holds each true neighbour.

``search(..., exact=True)`` then also visits every cell that could hold a better item. A vector is no closer to a query than the angle
between query and centre less the largest angle inside the cell, so cells whose bound lies below the k-th similarity found are left out and
the result equals that of comparing all pairs. Tight clusters leave out most cells, vectors without structure few.

A query set of proven small size is broadcast, and the index is read in place. A larger one is dealt out by cell; large
cells stand in pieces and their queries in blocks, so no task holds more than one piece and one block. Rows without
id or vector, and zero vectors, take no part. Equal similarities go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.functions.blocks import DIGITS, pair_similarities, unit_rows
from fretwork.functions.ranking import top_k
from fretwork.operators.vectors import MAX_BLOCK_BYTES, _final, _usable, cosine_top_k, fits_in_block
from fretwork.session import materialize

SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
ROUNDS = 8
PIECE_ROWS = 16_384
QUERY_ROWS = 4096
RERANK = 4
# Similarities that a task holds at one time.
PAIRS = 4_000_000
# The first cells of a query, which bound what may leave the others, hold about so many times the items that are kept.
NEAR = 4
# Vectors of the index that are asked for while it is written, to find the number of cells to visit.
TUNING_QUERIES = 100
RECALL = 0.95
LEVELS = 127
SLACK = 1e-9


@dataclass
class CellIndex:
    """``vectors``: item_id, cell, piece, scale, code, embedding; ``centres``: a unit row per cell."""

    vectors: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    probes: int

    @property
    def pieces(self) -> np.ndarray:
        return np.maximum(1, -(-self.counts // PIECE_ROWS))


def train_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centres of unit rows; the first rows are the first centres, an empty cell keeps its centre."""
    centres = sample[: min(n, len(sample))].copy()
    for _ in range(ROUNDS if len(sample) else 0):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _placed(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """(item_id, cell, angle, scale, code, embedding): zero vectors go."""
    kinds = {c: items.schema[c].dataType.simpleString() for c in ("item_id", "embedding")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = unit_rows(batch["embedding"]) if len(batch) else np.zeros((0, centres.shape[1]))
            fine = ~np.isnan(unit).any(axis=1)
            unit, batch = unit[fine], batch[fine]
            close = unit @ centres.T
            scale = np.abs(unit).max(axis=1) / LEVELS if len(unit) else np.zeros(0)
            codes = np.rint(unit / scale[:, None]).astype(np.int8)
            yield pd.DataFrame(
                {
                    "item_id": batch["item_id"].to_numpy(dtype=object),
                    "cell": close.argmax(axis=1).astype(np.int32),
                    "angle": np.arccos(np.clip(close.max(axis=1), -1, 1)) if len(unit) else np.zeros(0),
                    "scale": scale,
                    "code": [c.tobytes() for c in codes],
                    "embedding": batch["embedding"].to_numpy(),
                }
            )

    return items.mapInPandas(run, f"item_id {kinds['item_id']}, cell int, angle double, scale double, code binary, embedding {kinds['embedding']}")


def _wanted_probes(items: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """The number of cells that hold the share ``recall`` of the true neighbours of some of the items."""
    asked = items.orderBy(F.xxhash64("item_id", F.lit(2)), "item_id").limit(TUNING_QUERIES)
    asked = materialize(asked.withColumnRenamed("item_id", "query_id"), "cell-queries")
    hits = cosine_top_k(items, asked, k + 1).where("query_id <> item_id and rank <= " + str(k + 1))
    found = hits.join(placed.select("item_id", "cell"), "item_id").select("query_id", "cell").toPandas()
    rows = asked.toPandas().drop_duplicates("query_id")
    if not len(found):
        return len(centres)
    close = unit_rows(rows["embedding"]) @ centres.T
    rank = dict(zip(rows["query_id"], np.argsort(np.argsort(-close, axis=1, kind="stable"), axis=1), strict=True))
    places = np.sort([rank[q][c] for q, c in zip(found["query_id"], found["cell"], strict=True)])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def write_index(index: DataFrame, path: str, cells: int | None = None, k: int = 20, recall: float = RECALL) -> None:
    """Write the index of ``index`` (item_id, embedding) below ``path``. Its table of cells is written last."""
    items = _usable(index, "item_id")
    total = items.count()
    sample = items.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE_ROWS).toPandas()
    unit = unit_rows(sample["embedding"]) if len(sample) else np.zeros((0, 1))
    unit = unit[~np.isnan(unit).any(axis=1)]
    centres = train_centres(unit, cells or int(np.clip(round(total**0.5), 1, MAX_CELLS)))
    cell_table = "cell int, centre array<double>, radius double, n long, probes int"
    if not len(centres):
        index.sparkSession.createDataFrame([], cell_table).write.mode("overwrite").parquet(f"{path}/cells")
        return
    placed = materialize(_placed(items, centres), "cell-rows")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas().set_index("cell")
    counts = np.array([int(sizes["n"].get(c, 0)) for c in range(len(centres))], np.int64)
    radii = np.array([float(sizes["radius"].get(c, 0.0)) for c in range(len(centres))])
    n_pieces = [int(max(1, -(-n // PIECE_ROWS))) for n in counts]
    piece = F.pmod(F.xxhash64("item_id"), F.get(F.array(*[F.lit(n) for n in n_pieces]), F.col("cell"))).cast("int").alias("piece")
    stored = placed.select("item_id", "cell", piece, "scale", "code", "embedding")
    stored.repartition("cell", "piece").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    probes = _wanted_probes(items, placed, centres, k, recall)
    rows = [(c, centres[c].tolist(), float(radii[c]), int(counts[c]), probes) for c in range(len(centres))]
    table = index.sparkSession.createDataFrame(rows, cell_table)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def open_index(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))
    numbers = [np.array([r[c] for r in rows]) for c in ("radius", "n")]
    if rows:
        stored = spark.read.parquet(f"{path}/vectors")
    else:
        stored = spark.createDataFrame([], "item_id string, piece int, scale double, code binary, embedding array<double>, cell int")
    return CellIndex(stored, centres, *numbers, rows[0]["probes"] if rows else 0)


def visits(index: CellIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, cell): the cells whose centres are nearest to each query."""
    n, centres = min(probes or index.probes, len(index.centres)), index.centres
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = unit_rows(batch["embedding"]) if len(batch) else np.zeros((0, centres.shape[1]))
            fine = ~np.isnan(unit).any(axis=1)
            first = np.argsort(-(unit[fine] @ centres.T), axis=1, kind="stable")[:, :n]
            yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(dtype=object)[fine], n), "cell": first.ravel().astype(np.int32)})

    return _usable(queries, "query_id").mapInPandas(run, f"query_id {kind}, cell int")


def visited_pairs(index: CellIndex, visited: DataFrame) -> DataFrame:
    """(query_id, n_scored): how many items each query is compared with."""
    size = F.get(F.array(*[F.lit(int(n)) for n in index.counts]), F.col("cell"))
    return visited.groupBy("query_id").agg(F.sum(size).cast("long").alias("n_scored"))


def open_cells(index: CellIndex, queries: DataFrame, kth: DataFrame) -> DataFrame:
    """(query_id, cell, least): the cells that may hold an item of similarity ``least`` or more, the k-th found so far."""
    centres, radii, counts = index.centres, index.radii, index.counts
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = _usable(queries, "query_id").join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("least", F.lit(-2.0)).alias("least"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = unit_rows(batch["embedding"]) if len(batch) else np.zeros((0, centres.shape[1]))
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
            bound = np.cos(np.maximum(angle - radii - SLACK, 0)) + SLACK
            at, cell = np.nonzero((bound >= batch["least"].to_numpy()[:, None]) & (counts > 0) & ~np.isnan(bound))
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy(dtype=object)[at], "cell": cell.astype(np.int32), "least": batch["least"].to_numpy()[at]})

    return asked.mapInPandas(run, f"query_id {kind}, cell int, least double")


def _rows_of(stored: pd.DataFrame, coded: bool) -> np.ndarray:
    if not coded:
        return unit_rows(stored["embedding"])
    codes = np.frombuffer(b"".join(stored["code"]), np.int8).reshape(len(stored), -1)
    return codes * stored["scale"].to_numpy()[:, None]


def _hits(query_ids, cells, item_ids, similarities) -> pd.DataFrame:
    ids = {"query_id": pd.Series(query_ids, dtype=object), "cell": np.asarray(cells, np.int32), "item_id": pd.Series(item_ids, dtype=object)}
    return pd.DataFrame({**ids, "similarity": np.asarray(similarities, np.float64)})


def _best(query_ids: np.ndarray, asked: np.ndarray, items: np.ndarray, item_ids: np.ndarray, cell: int, keep: int, least: np.ndarray) -> Iterator[pd.DataFrame]:
    """The ``keep`` best items of each row of ``asked``, none below ``least``, a slice of the rows at a time."""
    step = max(1, PAIRS // max(1, len(items), 10 * keep))
    for start in range(0, len(query_ids), step):
        names, ids, values = [], [np.empty(0, dtype=object)], [np.empty(0)]
        sims = np.round(asked[start : start + step] @ items.T, DIGITS)
        for query_id, row, floor in zip(query_ids[start : start + step], sims, least[start : start + step], strict=True):
            at = np.flatnonzero(row >= floor)
            if len(at) > keep:
                at = at[row[at] >= np.partition(row[at], len(at) - keep)[len(at) - keep]]
                at = at[np.lexsort((item_ids[at], -row[at]))[:keep]]
            names += [query_id] * len(at)
            ids.append(item_ids[at])
            values.append(row[at])
        yield _hits(names, np.full(len(names), cell), np.concatenate(ids), np.concatenate(values))


def _visit_masks(visited: DataFrame, n_cells: int) -> pd.DataFrame:
    """(query_id, mask, least): a bit per cell, so that a block of queries with all its visits stays small."""

    @F.pandas_udf("binary")
    def mask(cells: pd.Series) -> pd.Series:
        def packed(one) -> bytes:
            bits = np.zeros(n_cells, np.uint8)
            bits[np.asarray(one, np.int64)] = 1
            return np.packbits(bits).tobytes()

        return cells.map(packed)

    per_query = visited.groupBy("query_id").agg(F.collect_set("cell").alias("cells"), F.max("least").alias("least"))
    return per_query.select("query_id", mask("cells").alias("mask"), "least").toPandas()


def _scored(index: CellIndex, queries: DataFrame, visited: DataFrame, keep: int, coded: bool, max_bytes: int) -> DataFrame:
    """(query_id, cell, item_id, similarity): per part of a visited cell the ``keep`` best items of each query that visits it.

    ``visited``: query_id, cell, least. By code if ``coded``, else exactly.
    """
    spark = index.vectors.sparkSession
    kinds = (queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["item_id"].dataType.simpleString())
    schema = "query_id {}, cell int, item_id {}, similarity double".format(*kinds)
    names = ["code", "scale"] if coded else ["embedding"]
    stored = index.vectors.select("item_id", "cell", "piece", *names)
    asked = _usable(queries, "query_id")

    if fits_in_block(asked, max_bytes):
        rows, n_cells = asked.toPandas(), len(index.centres)
        unit = unit_rows(rows["embedding"]) if len(rows) else np.zeros((0, 1))
        plan = rows[["query_id"]].merge(_visit_masks(visited, n_cells), on="query_id", how="left")
        none = bytes(-(-n_cells // 8))
        masks = np.frombuffer(b"".join(m if isinstance(m, bytes) else none for m in plan["mask"]), np.uint8).reshape(len(rows), -1)
        wanted = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(masks, axis=0, initial=0))).tolist() if len(rows) else []
        block = spark.sparkContext.broadcast((rows["query_id"].to_numpy(dtype=object), unit, masks, plan["least"].to_numpy(np.float64)))

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix, masks, least = block.value
            for batch in batches:
                for cell, part in batch.groupby("cell"):
                    items, item_ids = _rows_of(part, coded), part["item_id"].to_numpy(dtype=object)
                    visitors = np.flatnonzero(masks[:, int(cell) >> 3] & (128 >> (int(cell) & 7)))
                    for start in range(0, len(visitors), QUERY_ROWS):
                        at = visitors[start : start + QUERY_ROWS]
                        yield from _best(query_ids[at], matrix[at], items, item_ids, cell, keep, least[at])

        return stored.where(F.col("cell").isin(wanted)).mapInPandas(stream, schema)

    visited = materialize(visited, "cell-visits")
    blocks = visited.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks"))
    pieces = spark.createDataFrame([(c, int(n)) for c, n in enumerate(index.pieces)], "cell int, pieces int")
    layout = materialize(blocks.join(pieces, "cell"), "cell-layout")  # a row per visited cell, MAX_CELLS at most by default
    items = stored.join(F.broadcast(layout), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    posed = visited.join(asked, "query_id").join(F.broadcast(layout), "cell")
    posed = posed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    posed = posed.select("query_id", "cell", "block", "least", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("embedding").alias("asked"))

    def pair(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return _hits([], [], [], [])
        query_ids, item_ids = two["query_id"].to_numpy(dtype=object), one["item_id"].to_numpy(dtype=object)
        asked = unit_rows(two["asked"])
        return pd.concat(_best(query_ids, asked, _rows_of(one, coded), item_ids, one["cell"].iloc[0], keep, two["least"].to_numpy()), ignore_index=True)

    key = ["cell", "piece", "block"]
    return items.drop("blocks", "pieces").groupBy(*key).cogroup(posed.groupBy(*key)).applyInPandas(pair, schema)


def _coded_bounds(index: CellIndex, queries: DataFrame, keep: int, probes: int, max_bytes: int) -> DataFrame | None:
    """(query_id, least): what the ``keep``-th item of a query reaches at least by code, from the few cells nearest to it; None where those are many."""
    near = max(1, int(np.ceil(NEAR * keep * len(index.centres) / max(1, index.counts.sum()))))
    if 2 * near >= probes:
        return None
    hits = _scored(index, queries, visits(index, queries, near).withColumn("least", F.lit(-2.0)), keep, True, max_bytes)
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    return materialize(found.where(F.col("n") >= keep).select("query_id", (F.col("least") - SLACK).alias("least")), "cell-bounds")


def search(index: CellIndex, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False, max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Nearest items of each query (query_id, embedding) in the cells it visits: query_id, rank, item_id, similarity."""
    spark = queries.sparkSession
    if not len(index.centres):
        kinds = (queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["item_id"].dataType.simpleString())
        return spark.createDataFrame([], "query_id {}, rank int, item_id {}, similarity double".format(*kinds))
    first = visits(index, queries, probes)
    bounds = _coded_bounds(index, queries, RERANK * k, min(probes or index.probes, len(index.centres)), max_bytes)
    if bounds is None:
        first = first.withColumn("least", F.lit(-2.0))
    else:
        first = first.join(bounds, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    coded = _scored(index, queries, first, RERANK * k, True, max_bytes)
    best = top_k(coded, ["query_id"], [F.col("similarity").desc(), F.col("item_id")], RERANK * k).select("query_id", "cell", "item_id")

    @F.pandas_udf("double")
    def similarity(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(pair_similarities(one, two))

    full = index.vectors.select("cell", "item_id", "embedding")
    both = best.join(full, ["cell", "item_id"]).join(_usable(queries, "query_id").withColumnRenamed("embedding", "asked"), "query_id")
    hits = _final(both.select("query_id", "item_id", similarity("asked", "embedding").alias("similarity")), k)
    if not exact:
        return hits
    kth = materialize(hits, "cell-hits").where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
    rest = open_cells(index, queries, kth)
    return _final(_scored(index, queries, rest, k, False, max_bytes), k)
