"""Running lists of the k best items of many queries, inside a task."""

from __future__ import annotations

import numpy as np

#: Candidates that wait before they are merged into the lists.
HELD = 1 << 18
#: Entries of all lists of one task; searches deal their queries into blocks that stay below it.
LISTED = 1 << 20
#: Scores of one tile of queries and vectors.
TILE = 1 << 20


def _sortable(items: np.ndarray) -> np.ndarray:
    return np.unique(items, return_inverse=True)[1] if items.dtype == object else items


class KBest:
    """The k best (score, item) of each of n queries, ties by item. A query's floor is its k-th score: what is below it is
    not taken. Candidates wait in a buffer of bounded size, so memory is that of the lists and of ``HELD`` candidates,
    however many are offered. ``once``: an item may be offered several times and counts with its best score."""

    def __init__(self, n: int, k: int, once: bool = False, held: int | None = None):
        self.n, self.k, self.once, self.held = n, k, once, HELD if held is None else held
        self.floor = np.full(n, -np.inf)
        self._lists: list[np.ndarray] = []
        self._wait: list[tuple[np.ndarray, ...]] = []
        self._waiting = 0

    def offer(self, query: np.ndarray, score: np.ndarray, item: np.ndarray, *more: np.ndarray) -> None:
        """Candidates, with further columns that go with them."""
        good = np.flatnonzero(score >= self.floor[query])
        if not len(good):
            return
        self._wait.append(tuple(c[good] for c in (query, score, item, *more)))
        self._waiting += len(good)
        if self._waiting > self.held:
            self.settle()

    def settle(self) -> None:
        """Merges what waits into the lists and raises the floors."""
        if not self._wait:
            return
        columns = [np.concatenate(c) for c in zip(*([tuple(self._lists)] if self._lists else []), *self._wait, strict=True)]
        self._wait, self._waiting = [], 0
        query, score, item = columns[0], columns[1], _sortable(columns[2])
        if self.once:
            order = np.lexsort((-score, item, query))
            q, i = query[order], item[order]
            order = order[np.concatenate(([True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])))]
            columns, item = [c[order] for c in columns], item[order]
            query, score = columns[0], columns[1]
        order = np.lexsort((item, -score, query))
        q = query[order]
        starts = np.searchsorted(q, np.arange(self.n + 1))
        place = np.arange(len(order)) - starts[q]
        kept = order[place < self.k]
        self._lists = [c[kept] for c in columns]
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.floor[full] = score[order[starts[full] + self.k - 1]]

    def rows(self) -> list[np.ndarray]:
        """query, score, item and further columns of all lists, best first; no columns if nothing was offered."""
        self.settle()
        return self._lists


def offer_products(best: KBest, queries: np.ndarray, vectors: np.ndarray, items: np.ndarray, own: np.ndarray | None = None) -> None:
    """Offers the products of all queries and vectors, rounded to 9 places, a tile of ``TILE`` scores at a time. Of a tile only
    what reaches the floors is taken out, and of a query without a floor its k best of the tile, so no tile is sorted. ``own``:
    the item of each query that is not offered to it."""
    tall = max(1, TILE // max(1, len(vectors)))
    for low in range(0, len(queries), tall):
        scores = queries[low : low + tall] @ vectors.T
        if own is not None:
            scores[own[low : low + tall, None] == items[None, :]] = -np.inf
        least = best.floor[low : low + tall].copy()
        if not best.once and scores.shape[1] > best.k:
            fresh = np.flatnonzero(np.isneginf(least))
            least[fresh] = -np.partition(-scores[fresh], best.k - 1, axis=1)[:, best.k - 1]
        good = np.flatnonzero(scores >= np.maximum(least - 1e-9, -1e300)[:, None])
        best.offer(low + good // len(vectors), np.round(scores.ravel()[good], 9), items[good % len(vectors)])
