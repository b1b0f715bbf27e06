"""Nearest items of every item on the given tables, against plain arithmetic over all pairs."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fretwork.functions.blocks import hash_codes, hash_planes, unit_rows
from fretwork.operators import term_lists, text_vectors
from fretwork.session import materialize, scratch_scope
from fretwork.workload import vectors

# Hash codes that the inverted file has replaced on these vectors.
TABLES, BITS = 16, 6
SF_DIRS = ["/root/testdata/sf0.01", "/root/testdata/sf0.1"]


def check_lists(rows, hits):
    """Every 20th item has its five nearest items of all, in order."""
    rows = sorted(rows, key=lambda r: r.item_id)
    ids, unit = np.array([r.item_id for r in rows]), unit_rows([r.embedding for r in rows])
    found = {}
    for r in sorted(hits, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append(r.item_id)
    for i in range(0, len(ids), 20):
        sims = np.round(unit @ unit[i], 12)
        assert found[ids[i]] == list(ids[np.lexsort((ids, -sims))[:5]])
    assert len(hits) == 5 * len(rows)


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_similar_texts_are_the_nearest_of_all(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    with scratch_scope(spark):
        weights = materialize(vectors._text_weights(spark, sf_dir), "weights")
        nearest, scored = term_lists.nearest_by_terms(weights, 5, vectors.TEXT_BUCKETS)
        check_lists(text_vectors.dense_vectors(weights, vectors.TEXT_BUCKETS).collect(), nearest.collect())
        n, pairs = scored.agg(F.count(F.lit(1)), F.sum("scored")).first()
        assert pairs < 0.4 * n * n


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_similar_products_are_the_nearest_of_all(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    check_lists(vectors.index(spark, sf_dir).collect(), vectors.similar_products(spark, sf_dir).collect())


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_hash_index_costs_nearly_as_much_as_all_pairs_at_high_recall(spark, sf_dir):
    """With these codes and with four times the tables: the index reaches 0.9 only where most pairs are scored."""
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    unit = unit_rows([r.embedding for r in vectors.index(spark, sf_dir).collect()])
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    nearest = np.argsort(-sims, axis=1)[:, :5]

    def measured(tables):
        codes = hash_codes(unit, hash_planes(vectors.DIMENSION, tables, BITS), tables, BITS)
        pairs = np.zeros(sims.shape, bool)
        for t in range(tables):
            pairs |= codes[:, t][:, None] == codes[:, t]
        return np.take_along_axis(pairs, nearest, 1).mean(), pairs.mean()

    recall, _ = measured(TABLES)
    assert 0.5 < recall < 0.7
    recall, scored = measured(4 * TABLES)
    assert recall >= 0.9 and scored > 0.6
