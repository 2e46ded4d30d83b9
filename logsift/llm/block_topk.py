"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.vectors import Tile, ranked, slim, tiles

# Vectors of one range of a block; bounds are kept for each range.
RANGE_ROWS = 64
# Ranges scored between two looks at the bounds.
WAVE = 4
SCALE = 64  # fixed by the contract
# Sums of doubles below the first are exact, sums of 64-bit integers below the second.
DOUBLES, LONGS = 2.0**53, 2.0**63
LEAST = np.iinfo(np.int64).min


def quantised(data: np.ndarray) -> np.ndarray:
    """Whole numbers, as doubles: multiplying by a power of two and rounding down are exact."""
    return np.floor(data * SCALE)


class TopTile(Tile):
    """Scores ranges in order of their bounds until no bound reaches the k-th best score."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        super().__init__(ids, quantised(data), k)
        self.up, self.down = np.maximum(self.data, 0), np.minimum(self.data, 0)
        self.found = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # query, vector, score
        self.kth = np.full(len(ids), LEAST)

    def _product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            largest = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
        if largest < DOUBLES:
            return (left @ right.T).astype(np.int64)
        if largest < LONGS:
            return left.astype(np.int64) @ right.astype(np.int64).T
        return self._each(left, right)

    def _each(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sums that may not fit: those of doubles that are large enough say so, others are exact integers."""
        if not (np.isfinite(left).all() and np.isfinite(right).all()):
            raise OverflowError("a component is too large for its 64-fold")
        out = np.empty((len(left), len(right)), dtype=np.int64)
        whole = [[int(x) for x in row] for row in right.tolist()]
        for i, row in enumerate(left.tolist()):
            own = [int(x) for x in row]
            for j, other in enumerate(whole):
                score = sum(x * y for x, y in zip(own, other))
                if not LEAST <= score < -LEAST:
                    raise OverflowError("a score does not fit into 64 bits")
                out[i, j] = score
        return out

    def scan(self, ids: np.ndarray, data: np.ndarray) -> None:
        data = quantised(data)
        # neighbouring vectors share their largest component, which tightens the maxima
        top = np.abs(data).argmax(axis=1)
        order = np.lexsort((ids, data[np.arange(len(data)), top], top))
        ids, data = ids[order], data[order]
        starts = np.arange(0, len(ids), RANGE_ROWS)
        most = np.maximum.reduceat(data, starts, axis=0)
        least = np.minimum.reduceat(data, starts, axis=0)
        # summed term maxima; the slack covers the rounding of sums beyond 2**53
        with np.errstate(over="ignore", invalid="ignore"):
            bound = self.up @ most.T + self.down @ least.T
            terms = self.up @ np.abs(most).T - self.down @ np.abs(least).T
            bound = np.where(terms < DOUBLES, bound, bound + terms * 1e-12 + 1)
        bound[np.isnan(bound)] = np.inf
        ranges = np.argsort(-bound, axis=1, kind="stable")
        for wave in range(0, starts.size, WAVE):
            now = ranges[:, wave : wave + WAVE]
            # a double below an integer beyond 2**53, so that rounding never leaves a range out
            floor = self.kth.astype(np.float64)
            floor = np.where(np.abs(floor) < DOUBLES, floor, floor - np.abs(floor) * 1e-12)
            due = np.take_along_axis(bound, now, axis=1) >= floor[:, None]
            if not due.any():
                break
            hits = [self.found]
            for r in np.unique(now[due]).tolist():
                asking = np.flatnonzero(((now == r) & due).any(axis=1))
                part = slice(starts[r], starts[r] + RANGE_ROWS)
                score = self._product(self.data[asking], data[part])
                good = (score >= self.kth[asking][:, None]) & (
                    self.ids[asking][:, None] != ids[part][None, :]
                )
                q, v = np.nonzero(good)
                hits.append((asking[q], ids[part][v], score[q, v]))
            self._keep(*(np.concatenate(x) for x in zip(*hits)))

    def _keep(self, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        new = np.ones(query.size, dtype=bool)  # repeated rows count once
        new[1:] = (query[1:] != query[:-1]) | (vector[1:] != vector[:-1]) | (score[1:] != score[:-1])
        query, vector, score = query[new], vector[new], score[new]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(query.size) - first
        kept = place < self.k
        self.found = (query[kept], vector[kept], score[kept])
        last = place == self.k - 1
        self.kth[query[last]] = score[last]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, vector, score = self.found
        return self.ids[query], vector, score


def top_products(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    Each component x counts as floor(64 x), exactly; a score that does not fit into 64 bits ends the
    search with an error. Queries are the rows whose id
    every divides, candidates all rows with another id; ties go to the smaller id. Exact: a range
    of vectors is left out only if its bound is below the k-th best score. Vectors that are null,
    empty or hold a null or non-finite component, and rows without an id, take no part; vectors
    meet those of their own length. Rows equal in id and score count once.
    """
    found = tiles(slim(vectors, id_column, vector_column), every, k, TopTile, "bigint")
    return ranked(found, k, F.desc("score"))
