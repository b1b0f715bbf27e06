"""Vector retrieval: exact cosine top-k, an approximate index, candidate lists for hybrid search.

The exact search compares every query with every vector. A task multiplies its vectors with a block of queries and keeps
the best ``k`` per query, of which only those leave it that reach the query's k-th similarity in a sample of the index. The
approximate search scores the pairs that share a hash code, and no others. Rows without id or vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.functions.blocks import Best, hash_codes, hash_planes, pair_similarities, unit_rows
from fretwork.functions.ranking import top_k
from fretwork.schemas import VECTOR_METADATA

# Rows of the index, about, from which the lower bounds of the exact search are taken.
SAMPLE_ROWS = 20_000
# Queries up to this size (as doubles) travel to the tasks as one broadcast block. Beyond it, both sides are
# cut into blocks of about half this size.
MAX_BLOCK_BYTES = 64 * 1024 * 1024
HITS = "query_id {id}, item_id {id2}, similarity double"


def check_dimension(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """Vectors unchanged; the job fails on the first one of another length."""
    ok = F.size(column) == F.lit(dimension)
    message = F.format_string(f"vector of %d numbers where {dimension} are declared", F.size(column))
    return vectors.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(message)))


def _hit_schema(index: DataFrame, queries: DataFrame) -> str:
    return HITS.format(
        id=queries.schema["query_id"].dataType.simpleString(), id2=index.schema["item_id"].dataType.simpleString()
    )


def _final(hits: DataFrame, k: int) -> DataFrame:
    order = [F.col("similarity").desc(), F.col("item_id")]
    return top_k(hits, ["query_id"], order, k).select("query_id", "rank", "item_id", "similarity")


def fits_in_block(queries: DataFrame, max_bytes: int = MAX_BLOCK_BYTES) -> bool:
    """Whether all query vectors together, as doubles, stay below the bound."""
    size = queries.agg(F.sum(F.size("embedding").cast("bigint") * 8)).first()[0] or 0
    return size <= max_bytes


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, "embedding").where(F.col(key).isNotNull() & F.col("embedding").isNotNull())


def cosine_top_k(index: DataFrame, queries: DataFrame, k: int = 20, max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Exact nearest items per query: query_id, rank, item_id, similarity.

    ``index``: item_id, embedding; ``queries``: query_id, embedding. A query set of proven small size is
    broadcast and the index is only streamed through. A larger one is worked off in block pairs, with the same result.
    """
    items, asked = _usable(index, "item_id"), _usable(queries, "query_id")
    if not fits_in_block(asked, max_bytes):
        return _final(_block_pairs(items, asked, k, max_bytes // 2), k)
    rows = asked.toPandas()
    schema = _hit_schema(index, queries)
    if rows.empty:
        return _final(index.sparkSession.createDataFrame([], schema), k)
    context = index.sparkSession.sparkContext
    block = context.broadcast((rows["query_id"].to_numpy(dtype=object), unit_rows(rows["embedding"])))

    def search(least: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix = block.value
            best = Best(query_ids, k)
            for batch in batches:
                if len(batch):
                    best.add(matrix, batch["item_id"].to_numpy(dtype=object), unit_rows(batch["embedding"]))
            for found in best.frames():
                bounds = found["query_id"].map(least.value if least else {}).astype("float64").fillna(-2.0)
                yield found[found["similarity"] >= bounds]

        return run

    share = max(1, items.count() // SAMPLE_ROWS)
    sample = items.where(F.pmod(F.xxhash64("item_id"), F.lit(share)) == 0)
    kth = _final(sample.mapInPandas(search(None), schema), k).where(F.col("rank") == k)
    least = {r.query_id: r.similarity for r in kth.select("query_id", "similarity").collect()}
    return _final(items.mapInPandas(search(context.broadcast(least)), schema), k)


def _n_blocks(vectors: DataFrame, block_bytes: int) -> int:
    size = vectors.agg(F.sum(F.size("embedding").cast("bigint") * 8)).first()[0] or 0
    return max(1, -(-size // block_bytes))


def _block_pairs(index: DataFrame, queries: DataFrame, k: int, block_bytes: int) -> DataFrame:
    """Best ``k`` items of every index block for every query, one group per pair of blocks.

    Block numbers are digests of the unique ids, so blocks stay near their size whatever the data looks like.
    """
    n_items, n_queries = _n_blocks(index, block_bytes), _n_blocks(queries, block_bytes)
    items = index.select(
        "item_id",
        "embedding",
        F.pmod(F.xxhash64("item_id"), F.lit(n_items)).alias("item_block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)).cast("array<bigint>")).alias("query_block"),
    )
    asked = queries.select(
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)).cast("array<bigint>")).alias("item_block"),
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = Best(right["query_id"].to_numpy(dtype=object), k)
        if len(left) and len(right):
            best.add(unit_rows(right["embedding"]), left["item_id"].to_numpy(dtype=object), unit_rows(left["embedding"]))
        return best.frame()

    keys = ["item_block", "query_block"]
    return items.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, _hit_schema(index, queries))


def with_hash_codes(vectors: DataFrame, dimension: int, tables: int = 16, bits: int = 8) -> DataFrame:
    """``vectors`` with ``codes``: per table, on which side of ``bits`` planes a vector lies, and the table's number.

    Store an index with its codes to search it again and again.
    """
    planes = hash_planes(dimension, tables, bits)

    @F.pandas_udf("array<bigint>")
    def codes(column: pd.Series) -> pd.Series:
        return pd.Series(list(hash_codes(unit_rows(column), planes, tables, bits)))

    return vectors.where("embedding is not null").withColumn("codes", codes("embedding"))


def shared_code_pairs(coded_index: DataFrame, coded_queries: DataFrame) -> DataFrame:
    """(query_id, item_id): the pairs that share a code in some table, each once. A hot code is split by the skew handling."""
    items = coded_index.where("item_id is not null").select("item_id", F.explode("codes").alias("code"))
    asked = coded_queries.where("query_id is not null").select("query_id", F.explode("codes").alias("code"))
    return items.join(asked, "code").select("query_id", "item_id").distinct()


def approximate_top_k(
    coded: DataFrame, queries: DataFrame, dimension: int, k: int = 20, tables: int = 16, bits: int = 8
) -> DataFrame:
    """Nearest items among those that share a hash code with the query: query_id, rank, item_id, similarity.

    ``coded``: index with codes. An equi-join finds the pairs, only they are scored, exactly; that is all the work there is,
    for queries of any number. More bits mean fewer pairs, more tables more of the true neighbours.
    """
    asked = with_hash_codes(_usable(queries, "query_id"), dimension, tables, bits)
    pairs = shared_code_pairs(coded, asked)

    @F.pandas_udf("double")
    def similarity(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(pair_similarities(one, two))

    both = pairs.join(_usable(coded, "item_id"), "item_id").join(asked.select("query_id", F.col("embedding").alias("_asked")), "query_id")
    scored = both.select("query_id", "item_id", similarity("_asked", "embedding").alias("similarity"))
    return _final(scored.where(~F.isnan("similarity")), k)


def as_candidates(hits: DataFrame) -> DataFrame:
    """Hits as ranked candidate lists for the catalogue search; hits without an item are skipped.

    The rank of an item is its best one in the list.
    """
    return (
        hits.where(F.col("item_id").isNotNull())
        .groupBy(F.col("query_id").alias("request_id"), F.col("item_id").alias("product_id"))
        .agg(F.min("rank").alias("candidate_rank"))
    )


def vector_metadata() -> Column:
    """Data kept beside the vector of a product."""
    return F.struct(
        "product_id",
        F.col("product_name").alias("name"),
        "brand",
        "category",
        F.col("price").cast("double").alias("price"),
        "skill_level",
        "use_case",
        F.lit("product").alias("type"),
    ).cast(VECTOR_METADATA)
