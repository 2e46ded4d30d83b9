"""Nearest neighbours by int8 product tiles with error bounds, recomputed exactly."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.vectors import Tile, ranked, slim, tiles

# Relative slack for the rounding of the bounds themselves.
SLACK = 1e-9


class Quantised:
    """x = scale * codes + error, with the lengths of x and of the error."""

    def __init__(self, data: np.ndarray):
        largest = np.abs(data).max(axis=1)
        self.scale = np.where(largest > 0, largest, 1) / 127
        self.codes = np.rint(data / self.scale[:, None]).astype(np.int8)
        self.length = np.sqrt((data * data).sum(axis=1))
        error = data - self.scale[:, None] * self.codes
        self.error = np.sqrt((error * error).sum(axis=1))


def squared_distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, summed component by component in order, in doubles."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        apart = queries[:, d] - vectors[:, d]
        total += apart * apart
    return total


class NearestTile(Tile):
    """Keeps a heap of the k nearest for each query; a block's far vectors never leave int8."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        super().__init__(ids, data, k)
        self.rough = Quantised(data)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-distance, -id)

    def _bounds(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        mine = self.rough
        # products of int8 codes are whole numbers that single floats hold up to 2**24
        exact = np.float32 if self.data.shape[1] * 127 * 127 < 1 << 24 else np.float64
        tile = mine.codes.astype(exact) @ other.codes.astype(exact).T
        product = tile * mine.scale[:, None] * other.scale[None, :]
        error = np.outer(mine.length, other.error) + np.outer(mine.error, other.length + other.error)
        sizes = mine.length[:, None] ** 2 + other.length[None, :] ** 2
        error = 2 * error + SLACK * (sizes + 1)
        middle = sizes - 2 * product
        return middle - error, middle + error

    def scan(self, ids: np.ndarray, data: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            low, high = self._bounds(Quantised(data))
            own = self.ids[:, None] == ids[None, :]
            low[own] = high[own] = np.inf
            reach = np.full(len(self.ids), np.inf)
            if ids.size > 2 * self.k:
                # repeated rows could fill the k smallest, so they count once here
                _, first = np.unique(np.column_stack([ids, data]), axis=0, return_index=True)
                if first.size > self.k:
                    reach = np.partition(high[:, first], self.k - 1, axis=1)[:, self.k - 1]
            for i, heap in enumerate(self.heaps):
                if len(heap) == self.k:
                    reach[i] = min(reach[i], heap[0][0] ** 2 * (1 + SLACK) + SLACK)
            query, vector = np.nonzero(~(low > reach[:, None]) & ~own)
            for start in range(0, query.size, 1 << 16):
                part = slice(start, start + (1 << 16))
                self._push(query[part], ids[vector[part]], data[vector[part]])

    def _push(self, query: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        distance = np.sqrt(squared_distances(self.data[query], data))
        for i, d, v in zip(query.tolist(), distance.tolist(), ids.tolist()):
            heap, item = self.heaps[i], (-d, -v)
            if len(heap) < self.k:
                if item not in heap:
                    heapq.heappush(heap, item)
            elif item > heap[0] and item not in heap:
                heapq.heapreplace(heap, item)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [(q, -v, -d) for q, heap in zip(self.ids.tolist(), self.heaps) for d, v in heap]
        return (
            np.array([r[0] for r in rows], dtype=np.int64),
            np.array([r[1] for r in rows], dtype=np.int64),
            np.array([r[2] for r in rows], dtype=np.float64),
        )


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of every query, nearest first.

    Queries are the rows whose id every divides, candidates all rows with another id. The score
    is the Euclidean distance in doubles; ties go to the smaller id. The error bounds hold for
    every pair, so the result is exact. Vectors that are null, empty, all zero or hold a null or
    non-finite component, and rows without an id, take no part; vectors meet those of their own
    length. Rows equal in id and vector count once; fewer than k candidates are all returned.
    """
    rows = slim(vectors, id_column, vector_column).filter(F.exists("vector", lambda x: x != 0))
    found = tiles(rows, every, k, NearestTile, "double")
    return ranked(found, k, F.asc("score"))
