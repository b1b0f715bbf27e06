"""Mixture of sources by weight, allocated in equal blocks of words.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, 5, ...; they share the words of all documents by
weight. A target stops at ``MAX_REPEATS`` times the source's words, and what is over is shared by weight again.

Quotas: the mixture is a row of blocks of ``BLOCK_WORDS`` words. Sainte-Lague apportionment gives each next block to the
source with the highest quotient target / (2 * blocks so far + 1), ties to the earlier source. Output shard k holds the
blocks from k/SHARDS to (k+1)/SHARDS of that row, so each shard has integer quotas and nearly the mixture's proportions.
The number of blocks after any prefix is found from the few quotients around the proportional share, not block by block.

Selection: the documents of a source stand in seeded order and are read round and round; its n-th block is the n-th
``BLOCK_WORDS`` words. So a document is taken whole as often as there are full rounds, and perhaps once more, in part.
``stretches`` says where all of it goes: (shard, first word in the document, words), in the order of reading, so the words of
each source in each shard are exactly its quota.
The running word count of a source is taken in bands of the seeded order, so a hot source is no single task. Only the
table of sources, one row each, is ever in one task.

Nulls and ties: a null or blank text has size 0 and is never taken; null is a source of its own, after all others.
Documents of equal position are ordered by doc_id and text; rows that repeat are taken one after the other. An empty table
gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretwork.functions.ranking import running_total
from fretwork.llm.common import other_columns, packed, prepare, row_key, same_row, table
from fretwork.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARDS = 16
SEED = 7
POSITION_BITS = 32
BAND_BITS = 20
WORD = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, source, size) per row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", row_key().alias("_row"), "source", size.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, number, weight, source_size, target) per source of ``sizes`` (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.withColumn("number", number)
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("number") % len(weights)))
    # From the source that reaches its limit first: all before it stand at their limits, the rest is shared by weight.
    cap = F.col("source_size") * MAX_REPEATS
    order = Window.orderBy((cap / F.col("weight")), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("cap", cap).withColumn("level", level)
    leveled = leveled.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "number", "level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared["level"] * F.col("weight"))
    return leveled.select("source", "number", "weight", "source_size", target.alias("target"))


def blocks_after(shares: DataFrame, total: int, shards: int) -> DataFrame:
    """(shard, number, blocks): blocks of each source up to the end of each shard, 1 to ``shards``, of ``total`` blocks.

    With n sources a quota is never further than 1 + n/2 times its share from proportional, so only those quotients count.
    """
    n, everything = F.count(F.lit(1)).over(Window.partitionBy("shard")), F.sum("target").over(Window.partitionBy("shard"))
    shard = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")
    both = shares.where("target > 0").select("number", "target", shard)
    both = both.withColumn("total", F.expr(f"cast(shard as bigint) * {total} div {shards}"))
    share = both.withColumn("share", F.col("target") / everything).withColumn("slack", F.ceil(n * F.col("share") / 2) + 1)
    share = share.withColumn("mean", F.floor(F.col("total") * F.col("share")))
    share = share.withColumn("sure", F.greatest(F.col("mean") - F.col("slack"), F.lit(0)))
    open_blocks = share.select(
        "shard", "number", "total", "sure", "target", F.explode(F.sequence("sure", F.col("mean") + F.col("slack"))).alias("block")
    )
    quotient = F.col("target") / (F.col("block") * 2 + 1)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(quotient.desc(), "number"))
    left = F.col("total") - F.sum(F.when(F.col("block") == F.col("sure"), F.col("sure"))).over(Window.partitionBy("shard"))
    won = open_blocks.withColumn("won", (rank <= left).cast("long"))
    return won.groupBy("shard", "number").agg((F.min("sure") + F.sum("won")).alias("blocks"))


def quotas(shares: DataFrame, words: int, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(number, shard, first_block, blocks): the blocks of each source in each output shard."""
    upto = blocks_after(shares, (words + block_words // 2) // block_words, shards)
    before = F.coalesce(F.lag("blocks").over(Window.partitionBy("number").orderBy("shard")), F.lit(0))
    return upto.select("number", (F.col("shard") - 1).alias("shard"), before.alias("first_block"), (F.col("blocks") - before).alias("blocks"))


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, _row, source, size, source_size, target, taken, shard, stretches) per row of ``docs``.

    ``shard`` is the output shard of the first word that is taken, null where none is.
    """
    prepare(docs.sparkSession)
    rows = materialize(sized(docs), "mixing-sizes")
    shares = materialize(targets(rows), "mixing-targets")
    words = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = quotas(shares, words, shards, block_words).groupBy("number").agg(
        F.sum("blocks").alias("blocks"),
        F.sort_array(F.collect_list(F.struct("first_block", "shard", F.col("blocks").alias("n")))).alias("parts"),
    )
    limit = F.least(F.coalesce("blocks", F.lit(0)) * block_words, F.col("source_size") * MAX_REPEATS)
    plan = shares.join(parts, "number", "left").withColumn("take", limit).withColumnRenamed("source", "_source")
    plan = materialize(plan.select("_source", "number", "source_size", "target", "take", "parts"), "mixing-plan")

    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    at = F.conv(F.substring(F.md5(text), 1, POSITION_BITS // 4), 16, 10).cast("long")
    named = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("at", at)
    run = running_total(named, ["number"], "at", "size", "until", [F.col("doc_id"), F.col("_row")], BAND_BITS)
    run = run.withColumn("before", F.col("until") - F.col("size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    rest = F.least(F.greatest(F.col("take") - rounds * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    run = run.withColumn("taken", (rounds * F.col("size") + rest).cast("long"))
    return run.select(
        "doc_id", "_row", "source", "size", "source_size", "target", "taken", _stretches(block_words).alias("stretches")
    ).withColumn("shard", F.get("stretches", F.lit(0))["shard"])


def _stretches(block_words: int) -> Column:
    """What is taken of a document, cut where an output shard ends; a round begins ``source_size`` words after the one before."""

    def piece(a: Column, part: Column) -> Column:
        first = F.greatest(a, part["first_block"] * block_words)
        last = F.least(a + F.col("size"), F.col("take"), (part["first_block"] + part["n"]) * block_words)
        return F.struct(part["shard"].alias("shard"), (first - a).alias("first"), (last - first).alias("words"))

    starts = F.transform(F.sequence(F.lit(0), F.lit(MAX_REPEATS)), lambda r: r * F.col("source_size") + F.col("before"))
    pieces = F.flatten(F.transform(starts, lambda a: F.transform(F.coalesce("parts", F.array()), lambda p: piece(a, p))))
    return F.filter(pieces, lambda p: p["words"] > 0)


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them; a document that is taken in part stands whole.

    Rows of one doc_id, text and source stand one after the other in the mixture, so at most one such group of a source is taken unequally; only
    its rows are told apart, by their other columns.
    """
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = mixture(docs).groupBy("doc_id", "_row", "source").agg(F.min(times).alias("times"), (F.sum(times) - F.min(times) * F.count(F.lit(1))).alias("more"))
    taken = materialize(taken, "mixing-taken")
    rows, key = packed(docs, "source"), ["doc_id", "_row", "source"]

    def with_counts(counts: DataFrame) -> DataFrame:
        return rows.join(counts, same_row(rows, counts, *key)).select("doc", rows["doc_id"], rows["_row"], rows["source"], "times", "more")

    found = with_counts(taken.where("times > 0")).select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc")
    unequal = taken.where("more > 0")
    if not unequal.isEmpty():
        number = F.row_number().over(Window.partitionBy(*key).orderBy(other_columns()))
        found = found.unionByName(with_counts(unequal).withColumn("number", number).where("number <= more").select("doc"))
    return found.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "shard", "stretches")
    text = F.transform("stretches", lambda s: F.concat_ws(":", s["shard"].cast("string"), s["first"].cast("string"), s["words"].cast("string")))
    return rows.withColumns({"shard": F.coalesce(F.col("shard").cast("long"), F.lit(-1)), "stretches": F.array_join(text, ",")})


# Every quotient is listed and ranked, and the seeded order of a source is one window.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, source_size, number, [{", ".join(map(str, WEIGHTS))}][number % {len(WEIGHTS)} + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM d GROUP BY source)
), l AS (
  SELECT *, {MAX_REPEATS} * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum({MAX_REPEATS} * source_size) OVER (ORDER BY {MAX_REPEATS} * source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY {MAX_REPEATS} * source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, number,
    CASE WHEN level * weight >= cap THEN cap::DOUBLE
      ELSE weight * (SELECT level FROM l WHERE level * weight < cap ORDER BY cap / weight, number LIMIT 1) END AS target
  FROM l
), total AS (SELECT ((SELECT sum(size) FROM d)::BIGINT + {BLOCK_WORDS // 2}) // {BLOCK_WORDS} AS blocks
), q AS (
  SELECT number, block, row_number() OVER (ORDER BY target / (2 * block + 1) DESC, number) - 1 AS rank
  FROM (SELECT number, target, unnest(range((SELECT blocks FROM total))) AS block FROM t WHERE target > 0)
), won AS (
  SELECT number, block, (SELECT min(k) FROM range({SHARDS}) r(k) WHERE rank < (k + 1) * blocks // {SHARDS}) AS shard
  FROM q, total WHERE rank < blocks
), plan AS (
  SELECT t.*, least(coalesce(n, 0) * {BLOCK_WORDS}, {MAX_REPEATS} * source_size) AS take
  FROM t LEFT JOIN (SELECT number, count(*) AS n FROM won GROUP BY number) USING (number)
), o AS (
  SELECT doc_id, number, size, plan.source_size, target, take,
    sum(size) OVER (PARTITION BY number ORDER BY ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS rounds FROM o
), k AS (
  SELECT *, (rounds * size + least(greatest(take - rounds * source_size - before, 0), size))::BIGINT AS taken FROM r
), parts AS (
  SELECT number, shard, min(block) * {BLOCK_WORDS} AS lo, (max(block) + 1) * {BLOCK_WORDS} AS hi FROM won GROUP BY number, shard
), st AS (
  SELECT doc_id, string_agg(shard || ':' || (greatest(a, lo) - a) || ':' || (least(b, hi) - greatest(a, lo)), ',' ORDER BY a, lo) AS stretches
  FROM (SELECT doc_id, number, r * source_size + before AS a, least(r * source_size + before + size, take) AS b FROM k, range({MAX_REPEATS + 1}) q(r))
  JOIN parts USING (number) WHERE greatest(a, lo) < least(b, hi) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN shard::BIGINT ELSE -1 END AS shard, coalesce(stretches, '') AS stretches
FROM k LEFT JOIN won ON k.number = won.number AND won.block = k.before // {BLOCK_WORDS} LEFT JOIN st USING (doc_id)
"""
