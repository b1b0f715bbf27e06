"""The inverted-file index against plain arithmetic over all pairs."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import INDEX, QUERIES, brute, data, frames, lists

from fretwork.functions import blocks
from fretwork.functions.blocks import unit_rows
from fretwork.operators import cells
from fretwork.operators.vectors import cosine_top_k
from fretwork.workload import vectors

SF_DIRS = ["/root/testdata/sf0.01", "/root/testdata/sf0.1"]


def recall_and_share(index, opened, asked, k):
    """Recall against all pairs, and the share of all pairs that was compared."""
    hits = lists(cells.search(opened, asked, k))
    rows, questions = index.collect(), asked.collect()
    ids, unit = np.array([r.item_id for r in rows]), unit_rows([r.embedding for r in rows])
    found = 0
    for q in questions:
        sims = np.round(unit @ unit_rows([q.embedding])[0], 12)
        found += len(set(hits[q.query_id]) & set(ids[np.lexsort((ids, -sims))[:k]]))
    scored = cells.visited_pairs(opened, cells.visits(opened, asked)).agg(F.sum("n_scored")).first()[0]
    return found / (k * len(questions)), scored / (len(rows) * len(questions))


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_recall_on_given_vectors(spark, tmp_path, sf_dir):
    """Queries: ids divisible by 20. The given vectors have no cells to speak of, so a high recall visits many of them."""
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    index = vectors.index(spark, sf_dir)
    cells.write_index(index, str(tmp_path / "i"), k=vectors.K)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    asked = index.where(F.substring("item_id", 2, 20).cast("long") % 20 == 0).withColumnRenamed("item_id", "query_id")
    recall, share = recall_and_share(index, opened, asked, vectors.K)
    assert recall >= 0.9 and share < 0.85


def clustered(n=3000, centres=40, d=32, seed=6):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, d))
    return (middle[rng.integers(0, centres, n)] + 0.15 * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("max_bytes", [1 << 20, 500])
def test_clustered_vectors_need_few_cells(spark, tmp_path, max_bytes):
    items = clustered()
    index, asked = frames(spark, items, items[::20])
    cells.write_index(index, str(tmp_path / "i"), k=10)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    recall, share = recall_and_share(index, opened, asked, 10)
    assert recall >= 0.95 and share < 0.15
    kth = cells.search(opened, asked, 10, max_bytes=max_bytes).where("rank = 10").select("query_id", F.col("similarity").alias("least"))
    left = cells.visited_pairs(opened, cells.open_cells(opened, asked, kth)).agg(F.sum("n_scored")).first()[0]
    assert left < 0.3 * len(items) * len(items[::20])
    assert lists(cells.search(opened, asked, 10, exact=True, max_bytes=max_bytes)) == brute(items, items[::20], 10)


@pytest.mark.parametrize("max_bytes", [1 << 20, 500])
def test_exact_search_with_copies_and_a_zero_vector(spark, tmp_path, monkeypatch, max_bytes):
    """Hot cells stand in pieces, queries in blocks; the result does not show it."""
    monkeypatch.setattr(cells, "PIECE_ROWS", 30)
    monkeypatch.setattr(cells, "QUERY_ROWS", 5)
    items, asked = data()
    index, queries = frames(spark, items, asked)
    cells.write_index(index, str(tmp_path / "i"), cells=6, k=20)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    assert opened.pieces.max() > 3
    assert lists(cells.search(opened, queries, 20, probes=1, exact=True, max_bytes=max_bytes)) == brute(items, asked, 20)
    one, two = (lists(cells.search(opened, queries, 5, max_bytes=b)) for b in (1 << 20, 500))
    assert one == two


def test_only_visited_cells_are_read(spark, tmp_path):
    items = clustered(400)
    index, asked = frames(spark, items, items[:1])
    cells.write_index(index, str(tmp_path / "i"), cells=10)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    first = cells.visits(opened, asked, 2).withColumn("least", F.lit(-2.0))
    plan = cells._scored(opened, asked, first, 5, True, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "PartitionFilters: [cell" in scan and "embedding" not in scan


def test_empty_index_and_odd_rows(spark, tmp_path):
    none = spark.createDataFrame([], INDEX)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], QUERIES)
    cells.write_index(none, str(tmp_path / "none"))
    assert cells.search(cells.open_index(spark, str(tmp_path / "none")), asked, 3).count() == 0
    index = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0])], INDEX)
    cells.write_index(index, str(tmp_path / "few"))
    opened = cells.open_index(spark, str(tmp_path / "few"))
    for max_bytes in (1 << 20, 4):
        assert lists(cells.search(opened, asked, 3, exact=True, max_bytes=max_bytes)) == {1: ["a", "d"]}


@pytest.mark.parametrize("max_bytes", [1 << 20, 500])
def test_a_task_holds_few_similarities_and_hits(spark, tmp_path, monkeypatch, max_bytes):
    """All queries visit all cells: the pairs come in slices, with the result of comparing them at once."""
    items = clustered(n=1500, centres=5)
    index, asked = frames(spark, items, items[::5])
    cells.write_index(index, str(tmp_path / "i"), cells=6, k=10)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    whole = lists(cells.search(opened, asked, 10, probes=6))
    monkeypatch.setattr(cells, "PAIRS", 900)
    monkeypatch.setattr(blocks, "FRAME_QUERIES", 7)
    assert lists(cells.search(opened, asked, 10, probes=6, max_bytes=max_bytes)) == whole
    assert lists(cells.search(opened, asked, 10, exact=True, max_bytes=max_bytes)) == lists(cosine_top_k(index, asked, 10))
    ids, unit = np.array([f"i{n}" for n in range(300)], dtype=object), unit_rows(items[:300])
    parts = list(cells._best(ids[:60], unit[:60], unit, ids, 0, 10, np.full(60, -2.0)))
    assert len(parts) == 20 and sum(map(len, parts)) == 600


def test_visits_travel_as_a_bit_per_cell(spark):
    visited = spark.createDataFrame([("a", 0, -2.0), ("a", 9, -2.0), ("a", 9, -2.0), ("b", 3, 0.5)], "query_id string, cell int, least double")
    masks = {r.query_id: (r.mask, r.least) for r in cells._visit_masks(visited, 10).itertuples()}
    assert masks == {"a": (b"\x80\x40", -2.0), "b": (b"\x10\x00", 0.5)}


@pytest.mark.parametrize("max_bytes", [1 << 20, 500])
def test_bounds_from_the_nearest_cells_keep_hits_few(spark, tmp_path, monkeypatch, max_bytes):
    items = clustered(n=3000, centres=10)
    index, asked = frames(spark, items, items[::20])
    cells.write_index(index, str(tmp_path / "i"), cells=10, k=3)
    opened = cells.open_index(spark, str(tmp_path / "i"))
    scored, n_hits = cells._scored, []

    def counted(*args):
        hits = scored(*args)
        n_hits.append(hits.count())
        return hits

    monkeypatch.setattr(cells, "_scored", counted)
    bounded = lists(cells.search(opened, asked, 3, probes=10, max_bytes=max_bytes))
    monkeypatch.setattr(cells, "NEAR", 1000, raising=False)
    assert bounded == lists(cells.search(opened, asked, 3, probes=10, max_bytes=max_bytes))
    assert n_hits[-2] < n_hits[-1] / 4 and len(n_hits) == 3
