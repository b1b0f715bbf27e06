"""Line dedup: lines found in many documents stay in one of them only.

A text is split at newlines. The key of a line is the line without white space at its ends, A-Z lower-cased. A key of at least
``MIN_LENGTH`` characters that stands in at least ``MIN_DOCUMENTS`` documents is kept in the last of them, the one with
the largest doc_id (all its lines there), and dropped elsewhere.

Keys travel as two 64-bit hashes. The hash table is dealt out by ranges of (hash, document) and sorted by hash, document
and position, so the occurrences of one key stand together, and a key that is found everywhere spreads over many ranges.
Each range streams its sorted rows into one row per key (first occurrence, number of documents), and only these partial
rows meet. What comes back per document is its keep bitmap, compressed to runs of kept lines; texts never travel for it.

Nulls and ties: a null or empty text is one empty line. A null doc_id is a document before all others. Rows that repeat are
one document and get equal bitmaps; rows with one doc_id and different texts count as one document as well. An empty
table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import WHITE, lower_ascii, partitions, prepare, row_key, table
from fretwork.session import materialize

MIN_LENGTH = 40
MIN_DOCUMENTS = 5


def split_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _keys(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def line_hashes(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, _row, n_lines, marks): per row the long lines as (h1, h2, at), and the number of all lines."""
    lines = F.transform(split_lines(), lambda line, at: F.struct(_keys(line).alias("key"), at.alias("at")))
    long_lines = F.filter(lines, lambda x: F.char_length(x["key"]) >= min_length)
    marks = F.transform(
        long_lines, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["at"].alias("at"))
    )
    return docs.select("doc_id", row_key().alias("_row"), F.size(split_lines()).cast("long").alias("n_lines"), marks.alias("marks"))


def shared_keys(marked: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, keeper): the keys of enough documents, and the document that keeps their lines."""
    rows = marked.select("doc_id", F.explode("marks").alias("m")).select("m.h1", "m.h2", "doc_id", "m.at")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "at"]
    dealt = rows.repartitionByRange(partitions(marked.sparkSession), *order[:3]).sortWithinPartitions(*order)
    # All rows of a key and document are in one range, in order, so this needs no further shuffle.
    firsts = dealt.groupBy("h1", "h2", "doc_id").agg(F.first("at").alias("at"))
    last = F.max(F.struct("doc_id", "at"))["doc_id"]
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), last.alias("keeper")).where(F.col("n") >= min_documents).drop("n")


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, _row, n_lines, n_dropped, kept) for the rows that lose lines; ``kept``: runs (first line from 0, length)."""
    prepare(docs.sparkSession)
    marked = materialize(line_hashes(docs, min_length), "line-hashes")
    shared = materialize(shared_keys(marked, min_documents), "line-keys")
    rows = marked.select("doc_id", "_row", "n_lines", F.explode("marks").alias("m")).select("doc_id", "_row", "n_lines", "m.*")
    lost = rows.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    per_row = lost.groupBy("doc_id", "_row", "n_lines").agg(F.sort_array(F.collect_set("at")).alias("lost"))
    # Between two lost lines stands a run of kept ones, perhaps empty.
    edges = F.concat(F.array(F.lit(-1)), "lost", F.array(F.col("n_lines").cast("int")))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("lost")),
        lambda i: F.struct((F.get(edges, i) + 1).alias("first"), (F.get(edges, i + 1) - F.get(edges, i) - 1).alias("length")),
    )
    return per_row.select(
        "doc_id", "_row", "n_lines", F.size("lost").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] > 0).alias("kept")
    )


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with n_lines, n_dropped and the text that is left."""
    is_row = docs["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (F.xxhash64(docs["text"]) == bitmaps["_row"])
    # One plan at every size: left to Spark, the bitmaps would be broadcast while they are small, and the cost would jump beyond.
    both = docs.join(bitmaps.hint("merge"), is_row, "left").select(docs["doc_id"], docs["text"], bitmaps["n_dropped"], bitmaps["kept"])
    both = both.withColumn("lines", split_lines())
    left = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice("lines", r["first"] + 1, r["length"]))), "\n")
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = deduplicated(docs, materialize(keep_bitmaps(docs), "line-bitmaps"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), m AS (
  SELECT doc_id, place, line, coalesce(keeper <> doc_id, false) AS lost FROM k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
