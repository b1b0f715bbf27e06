"""Phrase search against plain containment."""

from __future__ import annotations

import random
import time

from fretwork.operators.phrases import phrase_hits

TEXTS = "text_id long, text string"
PHRASES = "phrase_id string, phrase string"


def result(spark, texts, phrases, **kwargs):
    found = phrase_hits(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(phrases, PHRASES), **kwargs)
    return sorted(map(tuple, found.collect()))


def brute(texts, phrases):
    return sorted((i, p) for i, t in texts for p, x in phrases if t is not None and p is not None and x and x.lower() in t.lower())


def test_equals_plain_containment(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abAB é\n") for _ in range(rng.randrange(60)))) for i in range(80)] + [(99, None), (100, "")]
    phrases = [(f"p{i}", "".join(rng.choice("abA é") for _ in range(rng.randrange(5)))) for i in range(60)] + [("x", None), (None, "a"), ("same", "AB"), ("same 2", "ab")]
    want = brute(texts, phrases)
    assert len(want) > 300
    assert result(spark, texts, phrases) == want == result(spark, texts, phrases, block_letters=40)


def test_no_phrases_or_texts(spark):
    assert result(spark, [(1, "a")], []) == result(spark, [(1, "a")], [("p", "")]) == result(spark, [], [("p", "a")]) == []


def test_ten_thousand_phrases_over_given_texts(spark):
    """As plain containment; a hundred times the phrases do not take ten times as long."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as text_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    rng, phrases = random.Random(2), []
    while len(phrases) < 10_000:
        text = rng.choice(texts)[1] or ""
        at = rng.randrange(max(1, len(text) - 30))
        phrases.append((f"p{len(phrases)}", text[at : at + rng.randrange(12, 30)]))
    times = []
    for n in (100, 10_000):
        table = spark.createDataFrame(phrases[:n], PHRASES)
        started = time.perf_counter()
        got = {tuple(r) for r in phrase_hits(docs, table).collect()}
        times.append(time.perf_counter() - started)
    some = rng.sample(phrases, 150)
    names = {p for p, _ in some}
    assert sorted(h for h in got if h[1] in names) == brute(texts, some)
    assert times[1] < 10 * max(times[0], 1)
