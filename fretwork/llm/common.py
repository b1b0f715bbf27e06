"""Settings, row identity and word hashing shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.session import apply_settings

# Rows and bytes of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

# White space and the ASCII letters, as the word and line rules of the queries name them (fixed values).
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_SPREAD = 0x9E3779B97F4A7C15


def prepare(spark: SparkSession) -> None:
    """Session settings for the Python stages, besides those of the library."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text") -> Column:
    """With doc_id the identity of a row: rows that repeat both get the same decision everywhere."""
    return F.xxhash64(F.col(text))


def same_row(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition on ``names`` in which NULL equals NULL."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and row key are not in ``decided`` (doc_id, _row); columns unchanged."""
    return docs.join(decided, _is_row(docs, decided), "left_anti")


def _is_row(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["_row"])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """(doc, doc_id, _row, ...names): whole rows in one column, beside their identity, so that no other column can clash with a helper's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"], F.xxhash64(docs["text"]).alias("_row"), *[docs[n] for n in names])


def other_columns() -> Column:
    """Orders the rows of ``packed`` that have one doc_id and text: by their other columns."""
    return F.xxhash64(F.to_json("doc"))


def one_row_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id and text of ``repeated`` (doc_id, _row), those that stand more than once.

    Each task keeps one row of a group before anything travels, so a group of any size is no task of its own.
    """
    lone = without(docs, repeated)
    rows = packed(docs)
    again = rows.join(repeated.withColumnRenamed("_row", "_same"), rows["doc_id"].eqNullSafe(repeated["doc_id"]) & (F.col("_row") == F.col("_same")), "left_semi")
    kept = again.groupBy("doc_id", "_row").agg(F.min_by("doc", other_columns()).alias("doc"))
    return lone.unionByName(kept.select("doc.*"))


def map_text(rows: DataFrame, made: str, compute: Callable[[list], list]) -> DataFrame:
    """``rows`` with new columns ``made`` (DDL) in place of text; ``compute`` takes a list of texts, returns one array each.

    The other columns pass as they are, also nulls and long integers.
    """
    kept = [c for c in rows.columns if c != "text"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + [made])
    names = kept + [part.split()[0] for part in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, new)], names)

    return rows.mapInArrow(run, ddl)


def move_into_place(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Give a whole file its name; a repeated task replaces what an earlier attempt left."""
    try:
        system.move(temporary, final)
    except OSError:
        system.delete_file(final)
        system.move(temporary, final)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def spread(values: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of 64-bit values to ``bits`` bits."""
    return ((values * np.uint64(_SPREAD)) >> np.uint64(64 - bits)).astype(np.int64)


def _powers(base: int, length: int) -> np.ndarray:
    """1-based powers of ``base`` modulo 2^64, kept between calls."""
    known = _POWERS.get(base)
    if known is None or len(known) < length:
        with np.errstate(over="ignore"):
            known = _POWERS[base] = np.cumprod(np.full(max(length, 1 << 17), base, np.uint64))
    return known[:length]


_POWERS: dict[int, np.ndarray] = {}
_CODES = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_INSIDE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def byte_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of ``codes`` (small integers): a polynomial, as the difference of two running sums."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_SPREAD, len(codes)), out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * _powers(pow(_SPREAD, -1, 1 << 64), len(codes))[starts]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> np.uint64(32))


def _block_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = _INSIDE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    return byte_hashes(_CODES[raw], starts, ends), np.diff(np.searchsorted(starts, bounds))


def word_hashes(texts, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the number of words of each text.

    Words end at ASCII white space; A-Z count as lower case. A block of texts is worked off at once.
    """
    hashes, counts, data, size = [], [], [], 0
    for text in texts:
        data.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        size += len(data[-1])
        if size >= block:
            done = _block_hashes(data)
            hashes.append(done[0])
            counts.append(done[1])
            data, size = [], 0
    if data:
        done = _block_hashes(data)
        hashes.append(done[0])
        counts.append(done[1])
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> int | None:
    """The ``k``-th largest value of a long column, by counting in ever finer bins: no sort, at most ``bins`` counts here."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    while low < high:
        width = (high - low) // bins + 1
        bin_of = F.expr(f"({column} - ({low}L)) div {width}L").alias("bin")
        counts = rows.where(F.col(column).between(low, high)).groupBy(bin_of).agg(F.count(F.lit(1)).alias("n")).collect()
        for at, n in sorted(((r["bin"], r["n"]) for r in counts), reverse=True):
            if k <= n or at == min(r["bin"] for r in counts):
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            k -= n
    return low
