"""Vector retrieval against plain arithmetic."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest

from fretwork.operators import text_vectors, vectors

INDEX = "item_id string, embedding array<float>"
QUERIES = "query_id int, embedding array<float>"


def data(n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    items = rng.standard_normal((n, d)).astype(np.float32)
    items[100:200] = items[100]  # a third of the rows are copies
    items[5] = 0
    asked = rng.standard_normal((12, d)).astype(np.float32)
    asked[3] = items[100]
    return items, asked


def frames(spark, items, asked):
    index = spark.createDataFrame([(f"P{i:04d}", v.tolist()) for i, v in enumerate(items)], INDEX).repartition(7)
    return index, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], QUERIES)


def brute(items, asked, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, np.nan, n)
    sims = np.round(unit(asked.astype(float)) @ unit(items.astype(float)).T, 12)
    best = {}
    for q, row in enumerate(sims):
        order = sorted((-s, f"P{i:04d}") for i, s in enumerate(row) if not np.isnan(s))
        best[q] = [i for _, i in order[:k]]
    return best


def lists(hits):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    return got


@pytest.mark.parametrize("max_bytes", [1 << 20, 500])
def test_exact_search_with_copies_and_a_zero_vector(spark, max_bytes):
    items, asked = data()
    index, queries = frames(spark, items, asked)
    assert lists(vectors.cosine_top_k(index, queries, 20, max_bytes)) == brute(items, asked, 20)


def test_no_queries(spark):
    index, queries = frames(spark, *data())
    assert vectors.cosine_top_k(index, queries.where("query_id < 0"), 3).count() == 0


def test_wrong_dimension_fails(spark):
    index = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], INDEX)
    assert vectors.check_dimension(index.where("item_id = 'a'"), "embedding", 2).count() == 1
    with pytest.raises(Exception, match="vector of 1 numbers where 2 are declared"):
        vectors.check_dimension(index, "embedding", 2).collect()


def test_hash_index_finds_copies_and_scores_exactly(spark, tmp_path):
    items, asked = data()
    index, queries = frames(spark, items, asked)
    vectors.with_hash_codes(index, 8, 4, 6).write.parquet(str(tmp_path / "index"))
    coded = spark.read.parquet(str(tmp_path / "index"))
    hits = vectors.approximate_top_k(coded, queries, 8, 5, 4, 6)
    assert lists(hits)[3] == [f"P{i:04d}" for i in range(100, 105)]
    exact = {(r.query_id, r.item_id): r.similarity for r in vectors.cosine_top_k(index, queries, 300).collect()}
    assert all(exact[r.query_id, r.item_id] == pytest.approx(r.similarity, abs=1e-9) for r in hits.collect())


def test_hash_index_scores_few_pairs_at_high_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    items = np.repeat(centres, 20, axis=0) + 0.25 * rng.standard_normal((1200, 16))
    asked = centres[:30] + 0.25 * rng.standard_normal((30, 16))
    index, queries = frames(spark, items.astype(np.float32), asked.astype(np.float32))
    coded = vectors.with_hash_codes(index, 16, 12, 8)
    got, want = lists(vectors.approximate_top_k(coded, queries, 16, 10, 12, 8)), lists(vectors.cosine_top_k(index, queries, 10))
    assert sum(len(set(got.get(q, [])) & set(want[q])) for q in want) >= 0.8 * 300
    assert vectors.shared_code_pairs(coded, vectors.with_hash_codes(queries, 16, 12, 8)).count() < 0.2 * 30 * 1200


def test_rows_without_id_or_vector_take_no_part(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], INDEX)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], QUERIES)
    for max_bytes in (1 << 20, 4):
        assert lists(vectors.cosine_top_k(index, queries, 5, max_bytes)) == {1: ["a", "c"]}
    assert lists(vectors.approximate_top_k(vectors.with_hash_codes(index, 2, 4, 1), queries, 2, 1, 4, 1)) == {1: ["a"]}


def test_lower_bounds_from_a_sample_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 40)
    items, asked = data()
    index, queries = frames(spark, items, asked)
    assert lists(vectors.cosine_top_k(index, queries, 7)) == brute(items, asked, 7)


def test_candidates_keep_the_best_rank(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, None)], "query_id int, rank int, item_id string")
    got = {(r.request_id, r.product_id, r.candidate_rank) for r in vectors.as_candidates(hits).collect()}
    assert got == {(1, "a", 1), (1, "b", 2)}


def test_embedding_text_skips_blank_parts(spark):
    row = ("Axe", "B", "Electric", "  ", None, "home", "Guitar")
    df = spark.createDataFrame(
        [row], "product_name string, brand string, subcategory string, description string, skill_level string, use_case string, category string"
    )
    assert df.select(text_vectors.embedding_text()).first()[0] == "Axe. B Electric. Use case: home. Category: Guitar"


def test_text_vectors_rank_by_shared_words(spark):
    texts = spark.createDataFrame(
        [("a", "red guitar with maple neck"), ("b", "drum kit"), ("c", "Guitar, MAPLE neck")], "item_id string, text string"
    )
    dense = text_vectors.dense_vectors(text_vectors.term_weights(texts, 256), 256)
    norms = [sum(x * x for x in r.embedding) for r in dense.collect()]
    assert norms == pytest.approx([1, 1, 1], abs=1e-5)
    asked = dense.where("item_id = 'a'").withColumnRenamed("item_id", "query_id")
    assert lists(vectors.cosine_top_k(dense, asked, 2))["a"] == ["a", "c"]


def test_texts_are_dealt_out_before_their_words_are_counted(spark):
    rows = [(f"P{i % 30}", f"word{i % 7} word{i % 5} Same same") for i in range(100)] + [(None, "same"), (None, "word1"), ("x", None), ("y", " - ")]
    texts = spark.createDataFrame(rows, "item_id string, text string").coalesce(1)
    counts = text_vectors.term_counts(texts, 1 << 20, task_chars=300)
    chars = sum(len(text or "") for _, text in rows)
    assert counts.rdd.getNumPartitions() == -(-chars // 300) > 5
    n_entries, tf, df = 0, {}, {}
    for item, text in rows:
        for word in re.findall(r"\w+", (text or "").lower()):
            tf[item, word] = tf.get((item, word), 0) + 1
    for _, word in tf:
        df[word] = df.get(word, 0) + 1
    raw = {(i, w): n * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for (i, w), n in tf.items()}
    want = {}
    for (item, word), value in raw.items():
        bucket = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % (1 << 12)
        want[item, bucket] = value / math.sqrt(sum(v * v for (i, _), v in raw.items() if i == item))
        n_entries += 1
    got = {(r.item_id, r.bucket): r.weight for r in text_vectors.term_weights(texts, 1 << 12).collect()}
    assert len(got) == n_entries and got == pytest.approx(want)
