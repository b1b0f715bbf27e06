"""Text of a product for retrieval, and sparse vectors made from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.session import materialize

# Characters whose words a task counts at once, about.
TASK_CHARS = 4_000_000


def embedding_text() -> Column:
    """The parts of a product in reading order, joined by ". "; blank parts are left out."""
    parts = F.array(
        F.col("product_name"),
        F.concat("brand", F.lit(" "), "subcategory"),
        F.col("description"),
        F.concat(F.lit("Skill level: "), "skill_level"),
        F.concat(F.lit("Use case: "), "use_case"),
        F.concat(F.lit("Category: "), "category"),
    )
    return F.array_join(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != ""), ". ")


def term_counts(texts: DataFrame, buckets: int, task_chars: int = TASK_CHARS) -> DataFrame:
    """Words per item and hash bucket: item_id, terms (bucket, tf).

    The texts are dealt out by item before their words are counted, in parts of about ``task_chars`` characters. So what a task
    counts does not depend on how few bytes the input takes, and no word travels.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = texts.select("item_id", "text").repartition(max(1, -(-chars // task_chars)), "item_id")
    words = dealt.select("item_id", F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")).alias("word"))
    digest = F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("bigint")
    hashed = words.where("word <> ''").select("item_id", (digest % buckets).alias("bucket"))
    counts = hashed.groupBy("item_id", "bucket").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy("item_id").agg(F.collect_list(F.struct("bucket", "tf")).alias("terms"))


def term_vectors(texts: DataFrame, buckets: int = 1024) -> DataFrame:
    """Unit-length tf-idf vectors, a row per item: item_id, entries (bucket, weight).

    ``texts``: item_id, text. Words are hashed into ``buckets`` positions, so an item has at most that many entries. The document
    counts, at most ``buckets`` numbers, go to every task, and each item is weighted in its own row.
    """
    counts = materialize(term_counts(texts, buckets), "term_counts")
    n_items = texts.count()
    per_bucket = counts.select(F.explode("terms.bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(n_items + 1.0) / (F.col("df") + 1.0)) + 1.0
    by_bucket = per_bucket.agg(F.map_from_entries(F.collect_list(F.struct("bucket", idf.alias("idf")))).alias("_df"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.try_element_at("_df", b.cast("bigint")))
    known = F.array(*[F.lit(x) for x in by_bucket.select(slots.alias("i")).first()["i"]]).cast("array<double>")
    weighted = F.transform("terms", lambda t: F.struct(t["bucket"], (t["tf"] * F.get(known, t["bucket"].cast("int"))).alias("w")))

    def unit(terms: Column) -> Column:
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["w"] * t["w"]))
        return _once(norm, lambda n: F.transform(terms, lambda t: F.struct(t["bucket"], (t["w"] / n).alias("weight"))))

    return counts.select("item_id", _once(weighted, unit).alias("entries"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row and not once for each entry that ``use`` goes through."""
    return F.element_at(F.transform(F.array(value), use), 1)


def term_weights(texts: DataFrame, buckets: int = 1024) -> DataFrame:
    """The vectors of ``term_vectors`` in long form: item_id, bucket, weight."""
    return term_vectors(texts, buckets).select("item_id", F.inline("entries"))


def dense_vectors(weights: DataFrame, buckets: int = 1024) -> DataFrame:
    """The same vectors as arrays (item_id, embedding), from the long form; a group holds at most ``buckets`` rows."""
    return dense(weights.groupBy("item_id").agg(F.collect_list(F.struct("bucket", "weight")).alias("entries")), buckets)


def dense(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """``term_vectors`` as arrays (item_id, embedding). Each entry is preceded by the zeros since the entry before it."""
    entries = F.sort_array(F.transform("entries", lambda e: F.struct(e["bucket"], e["weight"].cast("float").alias("weight"))))
    zero = F.lit(0.0).cast("float")

    def filled(e: Column) -> Column:
        def run(entry: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(e, i)["bucket"]).otherwise(F.lit(-1))
            gap = (entry["bucket"] - before - 1).cast("int")
            return F.concat(F.array_repeat(zero, gap), F.array(entry["weight"]))

        rest = (F.lit(buckets - 1) - F.element_at(e, -1)["bucket"]).cast("int")
        return F.concat(F.flatten(F.transform(e, run)), F.array_repeat(zero, rest))

    return rows.select("item_id", _once(entries, filled).alias("embedding"))
