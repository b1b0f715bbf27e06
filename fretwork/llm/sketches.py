"""Document fingerprints that keep every shingle hash below a fixed fraction (a threshold-scaled sketch).

A text is lower-cased (A-Z) and cut into words at ASCII white space; its shingles are all runs of ``SHINGLE`` words, the whole
sequence where there are fewer, the empty text where there are none. The hash of a shingle is the first 16 hex digits of
its MD5. The sketch holds the distinct hashes below one ``FRACTION``-th of all values. Which hashes stay does not depend on the document, so
sketches of very unequal size can be compared and merged: the sketch of a union is the union of the sketches. A sketch
would be empty for many short texts; the smallest hash therefore stays in any case, which a union keeps as well
(``merged``). The fingerprint is the sorted hashes, written one after the other.

``containment`` of one text in another is the share of its retained hashes that the other has, an unbiased estimate of the
share of its shingles: 1 for equal texts, about 1/2 for a text whose second half was replaced, whatever the length of the other.
``resemblance`` is their Jaccard similarity. Both are 0 to 1.

``edited`` puts each document beside the next one, in descending order of doc_id. The keys alone are sorted; the first key of each
range becomes the border of a block (a few blocks per task), and a document that opens a block goes as a guest to the block
before it. So each text travels once, whatever the distribution of the ids, and a block is no larger than a range.

Nulls and ties: a null text is empty. Documents of one doc_id stand in the order of their text's hash, a null doc_id after all
others. Rows that repeat in doc_id and text are one document, which has one next document, and are all returned. A lone
document is its own next. Other columns are not read. An empty table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretwork.llm.common import lower_ascii, partitions, prepare, row_key, table, without
from fretwork.session import materialize

SHINGLE = 5
FRACTION = 8
DIGITS = 16
BLOCKS_PER_TASK = 8
# Shingles that are hashed before those above the threshold go: bounds what a very long text holds at once.
CHUNK = 4096
SPACE = "[\\x20\\x09-\\x0D]+"


def _limit(fraction: int) -> str:
    """The first hash that a sketch leaves out, as hex digits."""
    return f"{(1 << 4 * DIGITS) // fraction:0{DIGITS}x}"


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles_hashed(words: Column, first: Column, last: Column, width: int) -> Column:
    """Hashes of the shingles that begin at words ``first`` to ``last`` (from 0)."""
    shingle = lambda i: F.array_join(F.slice(words, i + 1, width), " ")
    return F.transform(F.sequence(first, last), lambda i: F.substring(F.md5(shingle(i)), 1, DIGITS))


def sketch(text: Column, width: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted distinct hashes that the sketch of ``text`` retains; never empty."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return let(words, lambda w: sketch_of_words(w, width, fraction))


def sketch_of_words(words: Column, width: int, fraction: int) -> Column:
    last = F.greatest(F.size(words) - width, F.lit(0))
    below = F.transform(
        F.sequence(F.lit(0), last, F.lit(CHUNK)),
        lambda i: _retained(shingles_hashed(words, i, F.least(i + CHUNK - 1, last), width), fraction),
    )
    return merged_all(below, fraction)


def _retained(hashes: Column, fraction: int) -> Column:
    """What stays of some hashes: those below the threshold, or else the smallest."""
    small = lambda some: F.filter(some, lambda h: h < F.lit(_limit(fraction)))
    return let(hashes, lambda some: let(small(some), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.array_min(some)))))


def merged_all(sketches: Column, fraction: int = FRACTION) -> Column:
    """The sketch of a union, from an array of the sketches of its parts."""
    return F.array_sort(F.array_distinct(_retained(F.flatten(sketches), fraction)))


def merged(one: Column, two: Column, fraction: int = FRACTION) -> Column:
    return merged_all(F.array(one, two), fraction)


def containment(one: Column, two: Column) -> Column:
    """Share of the hashes of ``one`` that ``two`` has."""
    return F.size(F.array_intersect(one, two)) / F.size(one)


def resemblance(one: Column, two: Column) -> Column:
    return F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))


def _place() -> Column:
    """Sorts documents: descending doc_id, null last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("turned"), F.col("_row"))


def single_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, text, copies): each doc_id and text once, with the number of its rows. Only rows that repeat are gathered."""
    counts = docs.select("doc_id", row_key().alias("_row")).groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("copies"))
    repeated = materialize(counts.where("copies > 1"), "sketch-repeated")
    lone = without(docs, repeated).select("doc_id", row_key().alias("_row"), "text", F.lit(1).cast("long").alias("copies"))
    is_row = docs["doc_id"].eqNullSafe(repeated["doc_id"]) & (F.xxhash64(docs["text"]) == repeated["_row"])
    again = docs.join(repeated, is_row).select(docs["doc_id"], "_row", "text", "copies")
    return lone.unionByName(again.dropDuplicates(["doc_id", "_row"]))


def borders(keys: DataFrame) -> list:
    """The first place of each range of the sorted keys (doc_id, _row); one per range that holds any."""
    dealt = keys.select(_place().alias("place")).repartitionByRange(BLOCKS_PER_TASK * partitions(keys.sparkSession), "place")
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("place").alias("place"))
    return sorted(r["place"] for r in firsts.collect())


def _literal(place) -> Column:
    return F.struct(F.lit(place["none"]).alias("none"), F.lit(place["turned"]).cast("long").alias("turned"), F.lit(place["_row"]).cast("long").alias("_row"))


def _block(place: Column, firsts: list) -> Column:
    """Number of borders up to ``place``, less one. Two steps of about the square root of their number each."""
    step = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    upto = lambda some: F.size(F.filter(F.array(*map(_literal, some)), lambda b: b <= place))
    return F.coalesce(*[F.when(place >= _literal(g[0]), F.lit(i * step) + upto(g) - 1) for i, g in reversed(list(enumerate(groups)))], F.lit(0))


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, text, next_text) and the sketches of both as ``own`` and ``following``, per doc_id and text."""
    docs = docs.select("doc_id", "text")
    single = single_documents(docs)
    firsts = borders(docs.select("doc_id", row_key().alias("_row")).distinct())
    if not firsts:
        return single.select("doc_id", "copies", "text", F.col("text").alias("next_text"), sketch(F.col("text")).alias("own"), sketch(F.col("text")).alias("following"))
    placed = single.withColumn("place", _place()).withColumn("block", _block(F.col("place"), firsts))
    opens = F.get(F.array(*map(_literal, firsts)), F.col("block")) == F.col("place")
    home = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    away = F.struct(F.pmod(F.col("block") - 1, F.lit(len(firsts))).alias("block"), F.lit(True).alias("guest"))
    seats = placed.withColumn("seat", F.explode(F.when(opens, F.array(home, away)).otherwise(F.array(home))))
    seats = seats.select("doc_id", "copies", F.coalesce("text", F.lit("")).alias("text"), "place", "seat.block", "seat.guest")
    dealt = seats.repartition(partitions(docs.sparkSession), "block").withColumn("own", sketch(F.col("text")))
    order = Window.partitionBy("block").orderBy("guest", "place")
    both = dealt.withColumns({"next_text": F.lead("text").over(order), "following": F.lead("own").over(order)})
    return both.where("not guest").select("doc_id", "copies", "text", "next_text", "own", "following")


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, own, changed, following): each document, its edited text, and the three sketches.

    The last floor(n_chars / 2) characters give way to the first as many, or all, of the next document.
    """
    rows = beside_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    new = F.concat(F.expr("left(text, int(n_chars) - int(n_chars div 2))"), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", new).withColumn("changed", sketch(F.col("edited")))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.select("doc_id", "n_chars", "text", "edited", "own", "changed", "following", again.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).alias("near_edited"),
        containment(F.col("own"), F.col("following")).alias("near_next"),
    )


def _sql_sketch(text: str) -> str:
    return f"""(SELECT CASE WHEN len(list_filter(h, lambda x: x < '{_limit(FRACTION)}')) > 0 THEN list_sort(list_distinct(list_filter(h, lambda x: x < '{_limit(FRACTION)}')))
      ELSE [list_min(h)] END FROM (SELECT list_transform(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(0, len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[i + 1:i + {SHINGLE}], ' ')) END, lambda s: substr(md5(s), 1, {DIGITS})) AS h
      FROM (SELECT regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w)))"""


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
  FROM d WINDOW o AS (ORDER BY doc_id DESC)
), e AS (
  SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n
), s AS (
  SELECT doc_id, n_chars, edited, {_sql_sketch("text")} AS own, {_sql_sketch("edited")} AS changed, {_sql_sketch("next_text")} AS following FROM e
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
  len(list_intersect(own, changed)) / len(own) AS near_edited, len(list_intersect(own, following)) / len(own) AS near_next
FROM s
"""
