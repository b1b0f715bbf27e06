"""Documents that hold passages of a benchmark, also with single words replaced.

A word is a run of letters and digits, lower-cased. A document overlaps an item if some ``WINDOW`` consecutive words of
the item stand in the document, in step, with at most ``SUBSTITUTED`` of them replaced. Items with fewer words must
stand there whole and unchanged.

Hits come from spaced seeds: each mask names the positions that count, the others may hold any word. Hashes of the
masked words at every position of the documents are joined with those of the items. The two masks are chosen so that
every window with up to two replaced words still has an untouched seed, so no overlap is missed. Around each hit the
words are compared in step, and the windows are counted.

The items' hashes are broadcast up to ``BROADCAST_SEEDS``; beyond, Spark joins by shuffle. Items of equal words are
searched for once. A passage found in many documents only adds hits in proportion.

Nulls and ties: a null or blank text has no words and overlaps nothing; items without words are ignored; a null item_id
counts as an item. Rows that repeat each get their result. Empty tables give clean documents, or none. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import prepare, row_key, same_row, table, without
from fretwork.session import materialize

WINDOW = 13
SUBSTITUTED = 2
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
BROADCAST_SEEDS = 1_000_000
WORD_BREAK = "[^\\p{L}\\p{N}]+"


def word_codes(text: str = "text") -> Column:
    """64-bit hash of each word, in order."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAK)
    return F.transform(F.filter(parts, lambda word: word != ""), lambda word: F.xxhash64(word))


def _masked(codes: Column, number: int, offsets: tuple[int, ...]) -> Column:
    """Hash of the counting words of one mask at every position at which the mask fits."""
    last = F.size(codes) - (max(offsets) + 1)
    here = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(F.lit(number), *[F.get(codes, i + o) for o in offsets]),
    )
    return F.when(last >= 0, here).otherwise(F.array().cast("array<bigint>"))


def _short(length: int) -> tuple[int, tuple[int, ...]]:
    return 100 + length, tuple(range(length))


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, copies, codes): items of equal words once, under their smallest id."""
    rows = items.select("item_id", word_codes().alias("codes")).where(F.size("codes") > 0)
    return rows.groupBy("codes").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))


def _seeds(rows: DataFrame, ids: list[str], masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """(ids, at, seed): every masked hash of ``codes`` with its position."""
    placed = [F.transform(_masked(F.col("codes"), n, o), lambda h, i: F.struct(i.alias("at"), h.alias("seed"))) for n, o in masks]
    return rows.select(*ids, F.explode(F.concat(*placed)).alias("s")).select(*ids, "s.*")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _row, item_id, copies, shift, n_windows, first_word, last_word) per overlap in step.

    ``shift`` is the document position of the item's first word; first and last word count in the document.
    """
    known = materialize(item_table(items).withColumn("_item", F.xxhash64("codes")), "benchmark-items")
    lengths = sorted(r["n"] for r in known.select(F.size("codes").alias("n")).where(F.col("n") < WINDOW).distinct().collect())
    long_masks = list(enumerate(MASKS))
    own = _seeds(known.where(F.size("codes") >= WINDOW), ["_item"], long_masks)
    for n in lengths:
        own = own.unionByName(_seeds(known.where(F.size("codes") == n), ["_item"], [_short(n)]))
    own = materialize(own.select("_item", F.col("at").alias("item_at"), "seed").distinct(), "benchmark-seeds")
    if own.count() <= BROADCAST_SEEDS:
        own = F.broadcast(own)

    rows = docs.select("doc_id", row_key().alias("_row"), word_codes().alias("codes"))
    masks = long_masks + [_short(n) for n in lengths]
    hits = _seeds(rows, ["doc_id", "_row"], masks).select("doc_id", "_row", "at", "seed").join(own, "seed")
    hits = hits.select("doc_id", "_row", "_item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "benchmark-hits")

    found = hits.select("doc_id", "_row").distinct()
    keyed = docs.select("doc_id", row_key().alias("_row"), "text")
    texts = keyed.join(found, same_row(keyed, found, "doc_id", "_row"), "left_semi").dropDuplicates(["doc_id", "_row"])
    texts = texts.select("doc_id", "_row", word_codes().alias("_words"))
    both = hits.join(texts, same_row(hits, texts, "doc_id", "_row")).select(hits["*"], "_words").join(known, "_item")
    # Equal words in step, as 0 and 1 over the item; positions outside the document are unequal.
    equal = F.transform("codes", lambda word, i: F.coalesce(F.get("_words", i + F.col("shift")) == word, F.lit(False)))
    both = both.select("doc_id", "_row", "item_id", "copies", "shift", equal.alias("equal"), F.least(F.size("codes"), F.lit(WINDOW)).alias("width"))
    needed = F.when(F.col("width") < WINDOW, F.col("width")).otherwise(WINDOW - SUBSTITUTED)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("equal") - F.col("width")),
        lambda s: F.size(F.filter(F.slice("equal", s + 1, F.col("width")), lambda e: e)) >= needed,
    )
    return (
        both.select("*", starts.alias("starts"))
        .where(F.size("starts") > 0)
        .select(
            "doc_id", "_row", "item_id", "copies", "shift", F.size("starts").cast("long").alias("n_windows"),
            F.greatest(F.col("shift") + F.array_min("starts"), F.lit(0)).alias("first_word"),
            (F.col("shift") + F.array_max("starts") + F.col("width") - 1).alias("last_word"),
        )
    )


def marked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _row, contaminated, n_items, first_item, n_windows) per row of ``docs``."""
    prepare(docs.sparkSession)
    found = overlaps(docs, items)
    per_item = found.groupBy("doc_id", "_row", "item_id", "copies").agg(F.sum("n_windows").alias("n"))
    per_row = per_item.groupBy("doc_id", "_row").agg(
        F.sum("copies").alias("n_items"), F.min("item_id").alias("first_item"), F.sum("n").alias("n_windows")
    )
    per_row = materialize(per_row, "benchmark-documents")
    rows = docs.select("doc_id", row_key().alias("_row"))
    joined = rows.join(per_row, same_row(rows, per_row, "doc_id", "_row"), "left")
    return joined.select(
        rows["doc_id"], rows["_row"], F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item."""
    prepare(docs.sparkSession)
    return without(docs, materialize(overlaps(docs, items).select("doc_id", "_row").distinct(), "benchmark-documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = marked(docs, table(spark, sf_dir, "benchmark")).drop("_row")
    return rows.withColumn("first_item", F.coalesce("first_item", F.lit(-1)))


# Brute force: every pair of equal words, grouped by document, item and shift, then all windows of the item.
SQL = f"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)
), items AS (
  SELECT w, min(item_id) AS item_id, count(*) AS copies, len(w) AS n
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0 GROUP BY w
), i AS (
  SELECT item_id, copies, n, least(n, {WINDOW}) AS width, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM items
), step AS (
  SELECT doc_id, item_id, copies, n, width, d.place - i.place AS shift, i.place - 1 AS place
  FROM d JOIN i USING (word)
), dense AS (
  SELECT doc_id, item_id, copies, n, width, shift, list(place) AS places FROM step GROUP BY ALL
  HAVING count(*) >= CASE WHEN width < {WINDOW} THEN width ELSE {WINDOW - SUBSTITUTED} END
), windows AS (
  SELECT doc_id, item_id, copies, shift, width, s, len(list_filter(places, lambda a: a >= s AND a < s + width)) AS k
  FROM (SELECT *, unnest(range(0, n - width + 1)) AS s FROM dense)
), good AS (
  SELECT doc_id, item_id, copies, count(*) AS n_windows FROM windows
  WHERE k >= CASE WHEN width < {WINDOW} THEN width ELSE {WINDOW - SUBSTITUTED} END GROUP BY ALL
), per_doc AS (
  SELECT doc_id, sum(copies)::BIGINT AS n_items, min(item_id) AS first_item, sum(n_windows)::BIGINT AS n_windows FROM good GROUP BY doc_id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(first_item, -1) AS first_item, coalesce(n_windows, 0) AS n_windows
FROM documents LEFT JOIN per_doc USING (doc_id)
"""
