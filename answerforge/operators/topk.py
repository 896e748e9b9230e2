"""Running top-k per query inside a task: what leaves a task is k rows per query, however many it read."""

from __future__ import annotations

import numpy as np


class RunningTopK:
    """Best k (score descending, id ascending) of each query over score blocks that arrive one by one."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.q = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.float64)
        self.least = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: (queries, ids); what is -inf does not count."""
        n = scores.shape[1]
        if n > self.k:
            least = np.maximum(self.least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        else:
            least = self.least
        at, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        q, i, s = np.append(self.q, at), np.append(self.ids, ids[col]), np.append(self.scores, scores[at, col])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.ids, self.scores = q[keep], i[keep], s[keep]
        full = place[keep] == self.k - 1
        self.least[self.q[full]] = self.scores[full]


class SparseTopK:
    """Best k (score descending, id ascending) of each of many queries, from candidates that arrive one by one: they are gathered and
    merged when there are many, so a merge costs no more than the candidates it brings."""

    #: Candidates gathered before a merge, and queries merged at once.
    GATHERED, MERGED = 1 << 20, 1 << 15

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = np.zeros((queries, k), np.int64)
        self.scores = np.full((queries, k), -np.inf)
        self.least = np.full(queries, -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.new.append((q, ids, scores))
        self.count += len(q)
        if self.count >= self.GATHERED:
            self.merge()

    def merge(self) -> None:
        if not self.count:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new, self.count = [], 0
        for lo in range(0, len(self.least), self.MERGED):
            part = np.flatnonzero((q >= lo) & (q < lo + self.MERGED))
            if len(part):
                rows = np.unique(q[part])
                old, at = np.nonzero(self.scores[rows] > -np.inf)
                found = best(np.append(rows[old], q[part]), np.append(self.ids[rows[old], at], ids[part]), np.append(self.scores[rows[old], at], scores[part]), self.k)
                self.ids[found[0], found[3]], self.scores[found[0], found[3]] = found[1], found[2]
                self.least[rows] = self.scores[rows, -1]


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(q, id, score, place from 0): of each query the k best, in order."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[keep], scores[keep], place[keep]
