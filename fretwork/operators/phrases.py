"""Many phrases at once: which of them stand in which texts, by one automaton over all phrases.

Each text is walked once, whatever the number of phrases (Aho-Corasick). The automaton of a phrase table of proven size travels to the
tasks as one broadcast; a larger table is cut into blocks by a digest of the phrase, each with an automaton of its own and a
walk of its own. Upper and lower case are the same. A phrase that is NULL or empty stands in no text; equal phrases with
different ids are all found. NULL texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of the phrases in one automaton; it takes some tens of bytes for each.
BLOCK_LETTERS = 4_000_000


def _blocks(phrases: DataFrame, letters: int) -> list[DataFrame]:
    size = phrases.agg(F.sum(F.char_length("phrase").cast("bigint"))).first()[0] or 0
    n = max(1, -(-size // letters))
    return [phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i) for i in range(n)]


def _automaton(block: DataFrame) -> ahocorasick.Automaton | None:
    """Built from one block; each phrase leads to the place of its ids."""
    rows = block.groupBy("phrase").agg(F.sort_array(F.collect_set("phrase_id")).alias("ids")).toPandas()
    if not len(rows):
        return None
    found = ahocorasick.Automaton()
    for phrase, ids in zip(rows["phrase"], rows["ids"], strict=True):
        found.add_word(phrase, tuple(x.item() if hasattr(x, "item") else x for x in ids))
    found.make_automaton()
    return found


def phrase_hits(texts: DataFrame, phrases: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(text_id, phrase_id), once for each text (text_id, text) that contains the phrase (phrase_id, phrase)."""
    spark = texts.sparkSession
    lowered = phrases.select("phrase_id", F.lower("phrase").alias("phrase")).where("phrase <> '' and phrase_id is not null")
    rows = texts.select("text_id", F.lower("text").alias("text")).where("text is not null")
    kinds = texts.schema["text_id"].dataType.simpleString(), phrases.schema["phrase_id"].dataType.simpleString()
    schema = "text_id {}, phrase_id {}".format(*kinds)

    def search(automaton):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk = automaton.value
            for batch in batches:
                at, ids = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    found = {x for _, own in walk.iter(text) for x in own}
                    at += [i] * len(found)
                    ids += found
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(at, pa.int64())), pa.array(ids, kind)], ["text_id", "phrase_id"])

        return run

    kind = phrases.limit(0).toArrow().schema.field("phrase_id").type
    automata = [a for a in (_automaton(block) for block in _blocks(lowered, block_letters)) if a is not None]
    hits = [rows.mapInArrow(search(spark.sparkContext.broadcast(a)), schema) for a in automata]
    return reduce(DataFrame.unionByName, hits) if hits else spark.createDataFrame([], schema)
