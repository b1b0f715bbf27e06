"""Arithmetic on blocks of vectors inside a task."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Tasks carry this code along, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities held in memory at one time.
MAX_CELLS = 4_000_000
# Queries whose hits leave a task as one frame.
FRAME_QUERIES = 10_000
# Copies of a vector must tie exactly, so that the id decides, whatever block they are multiplied in.
DIGITS = 12


def unit_rows(vectors) -> np.ndarray:
    """Unit vectors as rows; a zero vector becomes NaN and is similar to nothing."""
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


class Best:
    """Best ``k`` items per query seen so far in one task; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object)] * len(query_ids)
        self.sims: list[np.ndarray] = [np.empty(0)] * len(query_ids)

    def add(self, queries: np.ndarray, item_ids: np.ndarray, items: np.ndarray) -> None:
        """Score unit rows against each other, a slice of the queries at a time."""
        step = max(1, MAX_CELLS // max(1, len(items)))
        for start in range(0, len(queries), step):
            sims = np.round(queries[start : start + step] @ items.T, DIGITS)
            for i, row in enumerate(sims):
                self._merge(start + i, item_ids, row)

    def _merge(self, q: int, item_ids: np.ndarray, row: np.ndarray) -> None:
        keep = np.flatnonzero(~np.isnan(row))
        if len(self.sims[q]) == self.k:
            keep = keep[row[keep] >= self.sims[q][-1]]
        if len(keep) > self.k:
            floor = np.partition(row[keep], len(keep) - self.k)[len(keep) - self.k]
            keep = keep[row[keep] >= floor]
        if len(keep):
            ids = np.concatenate([self.ids[q], item_ids[keep]])
            values = np.concatenate([self.sims[q], row[keep]])
            order = np.lexsort((ids, -values))[: self.k]
            self.ids[q], self.sims[q] = ids[order], values[order]

    def frame(self, start: int = 0, stop: int | None = None) -> pd.DataFrame:
        none, part = np.empty(0), slice(start, stop)
        return pd.DataFrame(
            {
                "query_id": pd.Series(np.repeat(self.query_ids[part], [len(s) for s in self.sims[part]]), dtype=object),
                "item_id": pd.Series(np.concatenate([none, *self.ids[part]]), dtype=object),
                "similarity": np.concatenate([none, *self.sims[part]]),
            }
        )

    def frames(self) -> Iterator[pd.DataFrame]:
        """``frame`` in slices of the queries."""
        for start in range(0, len(self.query_ids), FRAME_QUERIES):
            yield self.frame(start, start + FRAME_QUERIES)


def pair_similarities(one, two) -> np.ndarray:
    """Cosine of each pair of vectors."""
    if not len(one):
        return np.zeros(0)
    return np.round((unit_rows(one) * unit_rows(two)).sum(axis=1), DIGITS)


def hash_planes(dimension: int, tables: int, bits: int) -> np.ndarray:
    """Normals of all planes, from digests of plane and component, so that any system can make them."""
    digests = [hashlib.md5(f"{plane}:{i}".encode()).hexdigest()[:8] for plane in range(tables * bits) for i in range(dimension)]
    return (np.array([int(d, 16) for d in digests], dtype=np.float64) / 2**31 - 1).reshape(tables * bits, dimension)


def hash_codes(unit: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Code of each vector in each table; codes of different tables never coincide."""
    signs = (np.nan_to_num(unit) @ planes.T >= 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
