"""Posting blocks of asked terms, searched with the best weights of each block.

A block holds some thousand documents, and of each term the documents that have it, how often, and the largest share that any of them can take of the term's weight. A query
passes over a block whose terms together cannot reach what it has found; in others, documents that have only its weakest terms are not scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

K1, B = 1.5, 0.75  # fixed values of the scoring rule
DIGITS = 6  # of scores, by which documents are ranked


class Postings:
    """sizes: words of each document; doc, code: the asked terms that stand in them, once for each time; average: words of a document in the whole corpus."""

    def __init__(self, sizes: np.ndarray, doc: np.ndarray, code: np.ndarray, average: float):
        pairs, times = np.unique(code.astype(np.int64) * max(1, len(sizes)) + doc, return_counts=True)
        self.n, self.doc = len(sizes), pairs % max(1, len(sizes))
        share = times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[self.doc] / average)) if len(pairs) else np.zeros(0)
        term = pairs // max(1, len(sizes))
        start = np.flatnonzero(np.diff(term, prepend=-1))
        self.share = share
        self.part = {int(t): slice(i, j) for t, i, j in zip(term[start], start, [*start[1:], len(term)][: len(start)], strict=True)}
        self.best = dict(zip(self.part, np.maximum.reduceat(share, start).tolist() if len(start) else [], strict=True))
        self.read = 0  # postings scored so far

    def search(self, codes: list[int], weights: list[float], floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that have one of the terms and reach the floor, and their scores, for terms of these weights; a weight below zero counts as nothing in bounds."""
        own = sorted(((w * self.best[c], w, c) for c, w in zip(codes, weights, strict=True) if c in self.part), reverse=True)
        after = np.cumsum([0.0, *[max(0.0, x[0]) for x in reversed(own)]])[::-1]  # what the terms from each place on can bring
        if not own or after[0] < floor:
            return np.zeros(0, np.int64), np.zeros(0)
        score, has = np.zeros(self.n), np.zeros(self.n, bool)
        left = None
        for k, (_, w, c) in enumerate(own):
            at = self.part[c]
            doc, share = self.doc[at], self.share[at]
            if left is None and after[k] < floor:  # documents that have none of the terms before cannot reach it
                left = has.copy()
            if left is not None:
                left &= score + after[k] >= floor
                kept = left[doc]
                doc, share = doc[kept], share[kept]
            self.read += len(doc)
            score[doc] += w * share
            has[doc] = True
        found = np.flatnonzero((has if left is None else left) & (score >= floor))
        return found, score[found]


@dataclass
class Best:
    """The k best documents of a query so far, by rounded score, ties to the smaller id (null before all)."""

    k: int
    rows: list[tuple] = field(default_factory=list)  # (-score, id is not null, id)

    @property
    def floor(self) -> float:
        """A little below the last one's score, so that rounding hides none."""
        return -self.rows[-1][0] - 10.0**-DIGITS if len(self.rows) == self.k else -np.inf

    def add(self, scores: np.ndarray, places: np.ndarray, ids: list) -> None:
        scores = np.floor(scores * 10**DIGITS + 0.5) / 10**DIGITS
        if len(scores) > self.k:  # those above the k-th of them, and its ties by id below
            last = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, places = scores[scores >= last], places[scores >= last]
        self.rows = sorted([*self.rows, *((-s, ids[p] is not None, ids[p]) for s, p in zip(scores.tolist(), places.tolist(), strict=True))])[: self.k]
