"""Nearest texts by inverted lists against all pairs, on small tables of every kind."""

from __future__ import annotations

import numpy as np
import pytest

from fretwork.functions.blocks import DIGITS
from fretwork.operators.term_lists import nearest_by_terms
from fretwork.session import scratch_scope

SCHEMA = "item_id string, bucket long, weight double"


def vectors_of(rows, buckets):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    dense = np.zeros((len(ids), buckets), np.float32)
    for item, bucket, weight in rows:
        if item is not None:
            dense[ids.index(item), bucket] = weight
    dense = dense.astype(np.float64)
    return np.array(ids, object), dense / np.linalg.norm(dense, axis=1, keepdims=True)


def expected(rows, buckets, k):
    ids, unit = vectors_of(rows, buckets)
    out = set()
    for i, query in enumerate(ids):
        sims = np.round(unit @ unit[i], DIGITS)
        out |= {(query, rank + 1, ids[j], round(float(sims[j]), 9)) for rank, j in enumerate(np.lexsort((ids, -sims))[:k])}
    return out


def found(spark, rows, buckets, k, **limits):
    with scratch_scope(spark):
        hits, scored = nearest_by_terms(spark.createDataFrame(rows, SCHEMA), k, buckets, **limits)
        nearest = {(r.query_id, r["rank"], r.item_id, round(r.similarity, 9)) for r in hits.collect()}
        return nearest, {r.query_id: r.scored for r in scored.collect()}


def texts(n, buckets, seed):
    """Every item has the frequent terms 0 and 1 and a few of the others; some items are equal."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = np.random.default_rng(i // 2 if i % 7 == 0 else 1000 + i)
        rare = own.choice(np.arange(2, buckets), own.integers(1, 6), replace=False)
        rows += [(f"t{i:04d}", int(b), 0.2 if b < 2 else float(own.integers(1, 4))) for b in [0, 1, *rare]]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 40 * 60 * 8}, {"max_bytes": 40 * 60 * 8, "block_queries": 7}])
def test_equals_all_pairs_in_one_block_and_in_many(spark, limits):
    rows = texts(200, 40, 1)
    nearest, scored = found(spark, rows, 40, 4, **limits)
    assert nearest == expected(rows, 40, 4)
    assert len(scored) == 200 and sum(scored.values()) < 0.8 * 200 * 200


def test_items_without_a_common_term_fill_up(spark):
    rows = [(f"a{i}", i, 1.0) for i in range(5)] + [("b", 0, 2.0)]
    assert found(spark, rows, 8, 4)[0] == expected(rows, 8, 4)
    assert found(spark, rows, 8, 4, max_bytes=2 * 8 * 8)[0] == expected(rows, 8, 4)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(f"c{i:02d}", b, 1.0) for i in range(30) for b in (1, 3)]
    nearest, _ = found(spark, rows, 4, 3, max_bytes=9 * 4 * 8)
    assert nearest == {(f"c{i:02d}", r + 1, f"c{r:02d}", 1.0) for i in range(30) for r in range(3)}


def test_null_ids_and_no_rows(spark):
    rows = [("x", 0, 1.0), (None, 0, 1.0), ("y", 0, 0.5), ("y", 1, 0.5)]
    assert found(spark, rows, 2, 9)[0] == expected(rows, 2, 9)
    assert found(spark, [], 2, 9) == (set(), {})


def test_rarely_shared_terms_skip_nearly_all(spark):
    """Groups of six items with a rare term of their own, and terms that all have."""
    rows = [(f"g{i:04d}", b, w) for i in range(600) for b, w in ((0, 0.1), (1, 0.1), (2 + i // 6, 3.0))]
    nearest, scored = found(spark, rows, 102, 6)
    assert nearest == expected(rows, 102, 6)
    assert sum(scored.values()) < 0.02 * 600 * 600


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 9 * 40 * 8, "block_queries": 7}])
def test_equal_texts_are_compared_once(spark, limits):
    """Thirty texts, twenty items of each but for the last ones, which stand alone."""
    kinds = sorted({r[0] for r in texts(30, 40, 2)})
    rows = [(f"{(i * 7919) % 600:03d}", b, w) for i in range(600) for t, b, w in texts(30, 40, 2) if t == kinds[i % 30] and (i % 30 < 25 or i < 30)]
    nearest, scored = found(spark, rows, 40, 4, **limits)
    assert nearest == expected(rows, 40, 4)
    assert len(scored) == len({r[0] for r in rows}) and max(scored.values()) <= 30


def test_the_length_of_what_is_left_ends_a_search(spark):
    """Pairs of equal length in a term of their own; the largest weights of the frequent terms come from items that have little else."""
    rows = [(f"p{i:03d}", b, w) for i in range(400) for b, w in ((20 + i // 2, 3.0), *(((i + j) % 16, 0.6) for j in range(8)))]
    rows += [(f"z{j:03d}", j, 1.0) for j in range(16)]
    nearest, scored = found(spark, rows, 220, 2)
    assert nearest == expected(rows, 220, 2)
    assert sum(n for item, n in scored.items() if item < "z") < 0.02 * 400 * 416
