"""Prefix trie of conversations: identical ones collapse into weighted sequences, whose prefixes are the nodes.

A conversation is rebuilt from the first turns of the conversation that opens its block and its own later turns
(``rebuilt``). A node is a distinct sequence of the first d turns. It is named by d and two 64-bit values: the exclusive or,
over its turns, of a hash of the turn's place and content. So the name of every prefix is a running value that can be taken
in bands of a long conversation and put together, and no task needs a whole conversation.

Collapse: conversations that end at the same node are one sequence with a weight and a list of ends, which is kept in
pieces of ``END_IDS`` ids. Sequences whose node is the parent of another node are proper prefixes; an anti-join drops them,
what is left are the leaves. The prefixes of one representative per sequence, the smallest conversation, are added up with
the weights. Sums over subtrees need no pairs of nodes: each node belongs to the sequence of its smallest member, so a
sequence owns the lower end of its path; a subtree holds all that the sequences through its top own, less what
the owner of the top owns above it. Rows grow with the turns, whatever the depth.

Hot groups: turns are numbered by ranges of (conversation, turn), so one conversation may spread over all tasks; repeated turns
are counted before they travel; a first turn that all conversations share is only ever summed, or the hot side of a join
with unique keys, which adaptive execution splits. The text of a turn is read once and goes no further than its digest.

Nulls and ties: null role or text is empty; null turns come first; turns of one number stand in the order of their digest, and
repeated rows one after the other. Rows without conv_id belong to no conversation. A conversation that the rebuilding leaves
without turns ends at the root. Other columns are not read. An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fretwork.functions.ranking import running_total
from fretwork.llm.common import partitions, prepare, table
from fretwork.session import materialize

BLOCK = 20
HEADS = 4
END_IDS = 1024
BAND_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"

NODE = ["depth", "z1", "z2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words, n): distinct turns of each conversation and how often each stands there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    return rows.groupBy("conv_id", "turn", "digest").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): the turns of each conversation, numbered from 1."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turn_digests(conversations).repartitionByRange(partitions(conversations.sparkSession), F.col("conv_id"), *order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "trie-turns")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A range holds the start of many conversations, but goes on with one at most: no more carries than ranges.
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.withColumn("carry", F.sum("sum").over(earlier)).where("carry is not null").select("conv_id", "part", "carry")
    rows = dealt.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(materialize(carries, "trie-carries")), ["conv_id", "part"], "left")
    first = F.col("before") + F.coalesce("carry", F.lit(0)) + 1
    return rows.select("conv_id", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("at"), "digest", "words")


def rebuilt(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, depth, digest, words) of their rebuilt turns.

    With h = crc32 of the id modulo ``heads``: the first h turns of the conversation that opens the block of ``block`` ids, then
    the conversation's own turns after its first h.
    """
    rows = materialize(numbered_turns(conversations), "trie-numbered")
    borrowed = F.crc32(F.col("conv_id").cast("string")) % heads
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    convs = materialize(counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), borrowed.alias("h"), "n_turns"), "trie-ids")
    opening = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    # Where the opening conversation has fewer turns than are borrowed, the own turns move up.
    gaps = convs.join(opening, "base", "left").withColumn("gap", F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0))))
    gaps = materialize(gaps.where("gap > 0").select("conv_id", "gap"), "trie-gaps")
    own = rows.where(F.col("at") > borrowed).join(gaps, "conv_id", "left")
    own = own.select("conv_id", (F.col("at") - F.coalesce("gap", F.lit(0))).alias("depth"), "digest", "words")
    first = rows.where((F.col("conv_id") % block == 0) & (F.col("at") < heads)).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").where("at <= h")
    return convs.select("conv_id"), own.unionByName(lent.select("conv_id", F.col("at").alias("depth"), "digest", "words"))


def _marks() -> list[Column]:
    return [F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, z1, z2, p1, p2, words): the node after each turn and, as (depth - 1, p1, p2), its parent."""
    rows = turns.select("conv_id", "depth", "words", F.shiftright("depth", BAND_BITS).alias("band"), *[m.alias(f"m{i}") for i, m in enumerate(_marks(), 1)])
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("conv_id", "band").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    carries = bands.select("conv_id", "band", *[F.bit_xor(f"x{i}").over(earlier).alias(f"c{i}") for i in (1, 2)]).where("band > 0")
    rows = rows.withColumns({f"w{i}": F.bit_xor(f"m{i}").over(inside) for i in (1, 2)})
    rows = rows.join(materialize(carries, "trie-bands"), ["conv_id", "band"], "left")
    z = [F.col(f"w{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)]
    p = [z[i].bitwiseXOR(F.col(f"m{i + 1}")) for i in (0, 1)]
    names = ["z1", "z2", "p1", "p2"]
    return rows.select("conv_id", "depth", *[c.alias(n) for c, n in zip(z + p, names, strict=True)], "words")


def ends(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, z1, z2): the node at which each conversation ends."""
    last = nodes.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("last"))
    none = F.lit(0).cast("long")
    return convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col("last")[n], none).alias(n) for n in NODE])


def sequences(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, z1, z2, weight, leaf): distinct sequences by their smallest conversation; leaf 0 for proper prefixes of others."""
    weighted = materialize(stops.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "trie-weighted")
    parents = nodes.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2")).distinct()
    parents = materialize(parents, "trie-parents")
    leaves = weighted.join(parents, NODE, "left_anti").withColumn("leaf", F.lit(1))
    return leaves.unionByName(weighted.join(parents, NODE, "left_semi").withColumn("leaf", F.lit(0)))


def end_pieces(stops: DataFrame, size: int = END_IDS) -> DataFrame:
    """(depth, z1, z2, piece, ids): the conversations that end at a node, in order, as arrays of at most ``size`` ids."""
    piece = F.floor(F.col("conv_id") / size) if size & (size - 1) else F.shiftright("conv_id", size.bit_length() - 1)
    return stops.groupBy(*NODE, piece.alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))


def end_digests(pieces: DataFrame) -> DataFrame:
    """(depth, z1, z2, digest): SHA-256 of the comma-joined ids. The pieces of a long list are read one by one in their order."""
    texts = materialize(pieces.select(*NODE, "piece", F.array_join("ids", ",").alias("ids")), "trie-ends")
    counts = texts.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    several = materialize(counts.where("n > 1").select(*NODE), "trie-long-ends")
    single = texts.join(several, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("digest"))
    long_lists = texts.join(several, NODE, "left_semi").repartition(partitions(pieces.sparkSession), *NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = tuple(row[n] for n in NODE)
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(row["ids"].encode())
                else:
                    state.update(b"," + row["ids"].encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "digest"], d, strict=True)) for d in done], schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "digest"], (*node, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([("depth", pa.int64()), ("z1", pa.int64()), ("z2", pa.int64()), ("digest", pa.string())])
    return single.unionByName(long_lists.mapInArrow(run, "depth long, z1 long, z2 long, digest string"))


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (depth, z1, z2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and the lists of ``end_pieces``.

    ``convs`` (conv_id) has every conversation once, ``turns`` (conv_id, depth, digest, words) its turns, numbered from 1.
    """
    after = materialize(prefixes(turns), "trie-prefixes")
    stops = materialize(ends(convs, after), "trie-stops")
    found = materialize(sequences(stops, after), "trie-sequences")

    own = found.select("conv_id", "weight", "leaf")
    none = F.lit(0).cast("long")
    roots = own.select("conv_id", "weight", "leaf", *[none.alias(n) for n in [*NODE, "p1", "p2", "words"]])
    path = materialize(after.join(own, "conv_id").unionByName(roots), "trie-paths")
    nodes = path.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        ((F.sum("weight") - 1) * F.max("words")).alias("saved"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
    )
    nodes = materialize(nodes, "trie-nodes")

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned"))
    below = path.select("conv_id", *NODE).join(owned, "conv_id").groupBy(*NODE).agg(F.sum("owned").alias("owned"))
    until = running_total(nodes, ["conv_id"], "depth", "saved", "until", bits=BAND_BITS)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    rows = until.join(below, NODE).join(children, NODE, "left").join(parent, ["depth", "p1", "p2"], "left")
    return rows.select(
        *NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
        (F.col("owned") - F.col("until") + F.col("saved")).alias("saved_tokens"),
    ), end_pieces(stops)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    nodes, pieces = trie(*rebuilt(table(spark, sf_dir, "conversations")))
    rows = nodes.join(end_digests(pieces), NODE, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", nothing).alias("ends_sha256")
    )


# SQL keeps whole sequences; CRC-32 is written out bit by bit (its polynomial is a fixed value).
SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK} AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
      list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = base AND i <= h
  UNION ALL SELECT conv_id, i, role, text FROM c JOIN t USING (conv_id) WHERE i > h
), s AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), p AS (
  SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s
), k AS (
  SELECT conv_id, d, len(seq) = d AS stops, md5(to_json(seq[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(seq[1:d - 1])::VARCHAR) END AS parent,
    CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].text, '{WORD}')) ELSE 0 END AS words,
    list_transform(range(0, d + 1), lambda e: md5(to_json(seq[1:e])::VARCHAR)) AS above
  FROM p
), n AS (
  SELECT node, d AS depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, any_value(above) AS above,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '') AS ends
  FROM k GROUP BY node, d, parent
), kids AS (SELECT parent AS node, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent
), sub AS (
  SELECT up AS node, sum(saved) AS saved_tokens, count(*) FILTER (n IS NULL) AS n_leaves
  FROM (SELECT node, saved, unnest(above) AS up FROM n) LEFT JOIN kids USING (node) GROUP BY up
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sub USING (node) LEFT JOIN kids USING (node) LEFT JOIN n q ON q.node = n.parent
"""
