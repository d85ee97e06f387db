"""The nearest rows of many queries at once, met in batches: for the tasks of vector searches.

Products of unit vectors in single precision leave out what cannot be among a query's best;
the bound of their error is added to the limit, and what is left is scored in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows and queries whose products are held at once.
ROWS, QUERIES = 2_048, 512
#: Pairs that are scored in double precision at once.
PAIRS = 50_000
#: Below every cosine: products of pairs that don't count.
NEVER = np.float32(-9)
_LAST = np.iinfo(np.int64).max


def few_copies(x: np.ndarray, ids: np.ndarray, most: int, once: bool) -> np.ndarray:
    """Places of all rows but, of equal vectors, those with the least ids only; once: one row of an id and a vector."""
    _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    if len(group) == 0 or group.max() == len(group) - 1:
        return np.arange(len(ids))
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    if once:
        new = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
        order, g = order[new], g[new]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return np.sort(order[place < most])


class Nearest:
    """The best k of each query among the rows seen so far, ties by id.

    queries: unit vectors. score: a function of places of queries and of as many rows' vectors.
    own: the queries' ids, sorted, if a row of a query's id is none of its neighbours. once: rows of one id are one neighbour, by
    its nearest vector.
    """

    def __init__(self, queries: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, own: np.ndarray | None = None, once: bool = False) -> None:
        self.queries, self.score, self.k, self.own, self.once = queries.astype(np.float32), score, k, own, once
        self.error = (queries.shape[1] + 8) * 1.2e-7
        self.ids = np.full((len(queries), k), _LAST, dtype=np.int64)
        self.scores = np.full((len(queries), k), -np.inf)

    def see(self, ids: np.ndarray, unit: np.ndarray, x: np.ndarray, asking: Callable[[np.ndarray], np.ndarray] | None = None, some: np.ndarray | None = None) -> None:
        """Meets rows, at most ``ROWS``: ids, unit vectors and what ``score`` gets of them.

        some: places of the queries that meet them, by default all. asking: which of some places' queries (rows) meet which rows
        (columns), by default all.
        """
        unit = unit.astype(np.float32)
        pure = not self.once or len(np.unique(ids)) == len(ids)
        places = np.arange(len(self.queries)) if some is None else some
        for at in range(0, len(places), QUERIES):
            q = places[at : at + QUERIES]
            near = self.queries[q] @ unit.T
            if asking is not None:
                near[~asking(q)] = NEVER
            if self.own is not None:
                mine = np.searchsorted(self.own[q], ids)
                hit = np.flatnonzero(self.own[q][np.minimum(mine, len(q) - 1)] == ids)
                near[mine[hit], hit] = NEVER
            limit = self.scores[q, -1] - self.error
            fresh = np.flatnonzero(limit == -np.inf)
            limit = np.maximum(limit, -2).astype(np.float32)
            if len(fresh) and pure and near.shape[1] > self.k:
                # the k-th best of these rows bounds what counts, each side with its own error
                limit[fresh] = np.maximum(limit[fresh], np.partition(near[fresh], near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k] - np.float32(2 * self.error))
            met = np.flatnonzero(near.max(axis=1) >= limit)
            if len(met):
                a, b = np.nonzero(near[met] >= limit[met][:, None])
                for start in range(0, len(a), PAIRS):
                    which, row = q[met[a[start : start + PAIRS]]], b[start : start + PAIRS]
                    self._keep(which, ids[row], self.score(which, x[row]))

    def _keep(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = scores >= self.scores[q, -1]
        q, ids, scores = q[better], ids[better], scores[better]
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        ids, scores = np.concatenate([ids, self.ids[touched].ravel()]), np.concatenate([scores, self.scores[touched].ravel()])
        if self.once:
            order = np.lexsort((-scores, ids, q))
            order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
            q, ids, scores = q[order], ids[order], scores[order]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        top = place < self.k
        self.ids[touched], self.scores[touched] = _LAST, -np.inf
        self.ids[q[top], place[top]], self.scores[q[top], place[top]] = ids[top], scores[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores."""
        q, place = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, place], self.scores[q, place]
