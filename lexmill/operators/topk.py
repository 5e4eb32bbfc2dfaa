"""The k best documents for many queries at once over sums of weight x value by term, without scoring what can't be among them.

Queries that share their strongest terms meet the documents of those terms in one matrix product; a query ends when what its remaining
terms could add up to at most is below its k-th best score, so no document is left out that belongs to the result. Queries of many terms, whose
bounds exclude little, are summed over all documents that hold one. Products are in single precision
and only choose whom to score exactly; their error is allowed for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Queries, and documents and queries of one matrix product: few enough for a worker's memory.
_QUERIES, _COLUMNS, _CELLS = 125_000, 4_096, 4_000_000
#: Cells of (term, document) that are held at once, and the least documents for which that is worth it; else matrices are made from the hits.
_HELD, _LEAST = 10_000_000, 1_000
#: Queries of a group from which documents that were met before are left out; smaller groups meet the documents of their term together.
_GROUP = 16
#: Decimals of a score, and how far two of one rounded score can be apart.
_DECIMALS, _APART = 6, 2e-6
#: Terms of a query up to which bounds are used; _ERROR and the width of the tables of _Best hold for these. Queries of more terms that are handed on at once.
_SHORT, _LONG = 32, 10_000
#: Error of a sum in single precision as a share of the largest sum.
_ERROR = 4e-6


class Hits:
    """Values by document and by term; documents are numbered in the order of ties, from first on."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int, terms: int, first: int = 0):
        self.first = first
        order = np.lexsort((term, doc))
        self.documents, self.terms = documents, terms
        self.term, self.value, doc = term[order].astype(np.int32), value[order].astype(np.float64), doc[order].astype(np.int32)
        self.starts = np.append(0, np.cumsum(np.bincount(doc, minlength=documents)))
        by_term = np.argsort(self.term, kind="stable")
        self.docs_of = doc[by_term]
        self.starts_of = np.append(0, np.cumsum(np.bincount(self.term, minlength=terms)))
        self.most = np.zeros(terms + 1)
        np.maximum.at(self.most, self.term, self.value)
        self._all = None
        if terms * min(documents, _LEAST) <= _HELD:
            self._all = np.zeros((terms + 1, documents))
            self._all[self.term, doc] = self.value
            self._short = self._all.astype(np.float32)
        self._local = np.full(terms + 1, -1, np.int32)
        self._seen = np.zeros(documents, bool)

    def holding(self, term: int) -> np.ndarray:
        return self.docs_of[self.starts_of[term] : self.starts_of[term + 1]]

    def without(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Those of docs that hold none of the terms."""
        for t in terms:
            self._seen[self.holding(t)] = True
        left = docs[~self._seen[docs]]
        for t in terms:
            self._seen[self.holding(t)] = False
        return left

    def matrix(self, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of (term, document) in single precision; exact ones of all terms, or of these with a row of zeros at the end, and their columns."""
        if self._all is not None:
            return self._short[terms[:, None], docs], self._all, docs
        self._local[terms] = np.arange(len(terms))
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - ends + sizes, sizes)
        row = self._local[self.term[at]]
        some = row >= 0
        made = np.zeros((len(terms) + 1, len(docs)))
        made[row[some], np.repeat(np.arange(len(docs)), sizes)[some]] = self.value[at[some]]
        self._local[terms] = -1
        return made[:-1].astype(np.float32), made, np.arange(len(docs))


class _Best:
    """The best of a part of the queries so far; its rows are queries, their terms in order of the most that these can add."""

    def __init__(self, terms: int, starts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        self.k, self.none = k, terms
        sizes = np.diff(starts)
        count, width = len(sizes), int(sizes.max(initial=0))
        row, place = np.repeat(np.arange(count), sizes), np.arange(len(term)) - np.repeat(starts[:-1], sizes)
        self.term, self.weight = np.full((count, width), self.none, np.int32), np.zeros((count, width))
        self.term[row, place], self.weight[row, place] = term, weight
        self.score, self.doc = np.zeros((count, k)), np.full((count, k), -1, np.int32)

    def meet(self, hits: Hits, hidden: tuple[np.ndarray, np.ndarray]) -> None:
        """Take in what the documents of hits add; hidden: (query, document) that take no part."""
        self.hits = hits
        bound = self.weight * hits.most[self.term]
        order = np.argsort(-bound, axis=1, kind="stable").astype(np.int8)
        self.rest = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]
        self.lead = np.take_along_axis(self.term, order, 1)
        self.slack = _APART + _ERROR * self.rest[:, 0] if bound.shape[1] else np.zeros(len(bound))
        by_query = np.argsort(hidden[0], kind="stable")
        self.hidden = hidden[0][by_query], hidden[1][by_query] - hits.first
        self._by_terms()

    def open(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Those of rows that a document with a score of bound could still enter."""
        return rows[(bound > 0) & (bound + _APART >= self.score[rows, -1])]

    def add(self, rows: np.ndarray, docs: np.ndarray) -> None:
        """Score documents, none of them seen before, for some queries."""
        for low in range(0, len(docs), _COLUMNS):
            part = docs[low : low + _COLUMNS]
            step = max(1, _CELLS // len(part))
            for begin in range(0, len(rows), step):
                self._add(rows[begin : begin + step], part)

    def _add(self, rows: np.ndarray, docs: np.ndarray) -> None:
        sub, weight = self.term[rows], self.weight[rows]
        used, local = np.unique(sub, return_inverse=True)
        local = local.reshape(sub.shape)
        known = used[used < self.none]
        if len(rows) > 1 and len(known) * len(docs) > _CELLS:
            for half in np.array_split(rows, 2):
                self._add(half, docs)
            return
        values, full, place = self.hits.matrix(docs, known)
        at = sub if len(full) == self.none + 1 else local
        weights = np.zeros((len(rows), len(known) + 1), np.float32)
        weights[np.arange(len(rows))[:, None], local] = weight
        scores = weights[:, : len(known)] @ values
        self._hide(scores, rows, docs)
        slack, bar = self.slack[rows], self.score[rows, -1]
        if len(docs) > 2 * self.k:
            blocks = min(len(docs), max(64, 4 * self.k))
            wide = len(docs) // blocks
            tops = scores[:, : blocks * wide].reshape(len(rows), blocks, wide).max(axis=2)
            bar = np.maximum(bar, np.partition(tops, blocks - self.k, axis=1)[:, blocks - self.k] - slack)
        bar = np.maximum(bar - slack, 0)
        row, col = np.nonzero((scores >= bar[:, None].astype(np.float32)) & (scores > 0))
        exact = np.zeros(len(row))
        for j in range(sub.shape[1]):
            exact += weight[row, j] * full[at[row, j], place[col]]
        exact = np.round(exact, _DECIMALS)
        held = (exact > 0) & (exact >= self.score[rows[row], -1])
        self._merge(rows, row[held], docs[col[held]] + self.hits.first, exact[held])

    def _hide(self, scores: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> None:
        begin, end = np.searchsorted(self.hidden[0], rows), np.searchsorted(self.hidden[0], rows, "right")
        sizes = end - begin
        if sizes.any():
            row = np.repeat(np.arange(len(rows)), sizes)
            at = np.arange(len(row)) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
            order = np.argsort(docs)
            place = np.minimum(np.searchsorted(docs, self.hidden[1][at], sorter=order), len(docs) - 1)
            hit = docs[order[place]] == self.hidden[1][at]
            scores[row[hit], order[place[hit]]] = -1

    def _merge(self, rows: np.ndarray, row: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        old, rank = np.nonzero(self.doc[rows] >= 0)
        row = np.concatenate([old, row])
        doc, score = np.concatenate([self.doc[rows][old, rank], doc]), np.concatenate([self.score[rows][old, rank], score])
        order = np.lexsort((doc, -score, row))
        order = order[np.append(True, (row[order][1:] != row[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]]
        row, doc, score = row[order], doc[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.doc[rows[row[kept]], place[kept]] = doc[kept]
        self.score[rows[row[kept]], place[kept]] = score[kept]

    def _by_terms(self) -> None:
        """Term by term, the strongest first: documents that hold it and none before it."""
        rows, group = np.arange(len(self.term)), np.zeros(len(self.term), np.int64)
        for j in range(self.term.shape[1]):
            left = self.open(rows, self.rest[rows, j])
            group = group[np.searchsorted(rows, left)]
            rows = left
            if not len(rows):
                return
            lead = self.lead[rows, j]
            kinds, group = np.unique(group * (self.none + 1) + lead, return_inverse=True)
            apart = len(kinds) * _GROUP <= len(rows) or not j
            by = group if apart else lead
            order = np.argsort(by, kind="stable")
            for own in np.split(rows[order], np.flatnonzero(np.diff(by[order])) + 1):
                terms = self.lead[own[0], : j + 1]
                docs = self.hits.holding(terms[-1])
                if apart:
                    docs = self.hits.without(docs, terms[:-1])
                if len(docs):
                    self.add(own, docs)


def best(doc: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int, terms: int, asked: tuple, k: int, hidden: tuple) -> Iterator[tuple]:
    """(query, document, score) of the k best with a score above 0, ties by document, from hits (doc, term, value).

    asked: (starts, term, weight), the terms of each query from its start on; hidden: (query, document) that take no part.
    """
    short = np.diff(asked[0]) <= _SHORT
    rows = np.flatnonzero(short)
    if len(rows) < len(short):
        yield from _summed(doc, term, value, documents, terms, asked, np.flatnonzero(~short), k, hidden)
        kept, there = np.repeat(short, np.diff(asked[0])), short[hidden[0]]
        used, own = np.unique(asked[1][kept], return_inverse=True)  # the terms of long queries alone would only make blocks of documents small
        asked = np.append(0, np.cumsum(np.diff(asked[0])[rows])), own, asked[2][kept]
        place = np.full(terms, -1)
        place[used] = np.arange(len(used))
        some = place[term] >= 0
        doc, term, value, terms = doc[some], place[term[some]], value[some], len(used)
        hidden = np.searchsorted(rows, hidden[0][there]), hidden[1][there]
    starts, own_term, own_weight = asked
    wide = max(min(_LEAST, documents), _HELD // max(terms, 1)) or 1
    order = np.argsort(doc, kind="stable")
    doc, term, value = doc[order], term[order], value[order]
    edges = np.append(np.arange(0, documents, wide), documents)
    cuts = np.searchsorted(doc, edges)
    for low in range(0, len(starts) - 1, _QUERIES):
        own = starts[low : low + _QUERIES + 1]
        part = _Best(terms, own - own[0], own_term[own[0] : own[-1]], own_weight[own[0] : own[-1]], k)
        for begin, end, a, b in zip(edges, edges[1:], cuts, cuts[1:]):
            there = (hidden[0] >= low) & (hidden[0] < low + _QUERIES) & (hidden[1] >= begin) & (hidden[1] < end)
            hits = Hits(doc[a:b] - begin, term[a:b], value[a:b], end - begin, terms, begin)
            part.meet(hits, (hidden[0][there] - low, hidden[1][there]))
        row, rank = np.nonzero(part.doc >= 0)
        yield rows[row + low], part.doc[row, rank], part.score[row, rank]


def _summed(doc: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int, terms: int, asked: tuple, rows: np.ndarray, k: int, hidden: tuple) -> Iterator[tuple]:
    """The same for some rows of asked; a document's terms are added in the order of the query's, as in _Best."""
    starts, own_term, own_weight = asked
    order = np.argsort(term, kind="stable")
    doc, value = doc[order], value[order]
    starts_of = np.append(0, np.cumsum(np.bincount(term, minlength=terms)))
    by_query = np.argsort(hidden[0], kind="stable")
    hidden = hidden[0][by_query], hidden[1][by_query]
    for low in range(0, len(rows), _LONG):
        found = []
        for q in rows[low : low + _LONG]:
            own = own_term[starts[q] : starts[q + 1]]
            sizes = starts_of[own + 1] - starts_of[own]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(starts_of[own] - ends + sizes, sizes)
            score = np.round(np.bincount(doc[at], np.repeat(own_weight[starts[q] : starts[q + 1]], sizes) * value[at], documents), _DECIMALS)
            score[hidden[1][np.searchsorted(hidden[0], q) : np.searchsorted(hidden[0], q, "right")]] = 0
            bar = np.partition(score, documents - k)[documents - k] if documents > k else 0
            some = np.flatnonzero((score > 0) & (score >= bar))
            some = some[np.argsort(-score[some], kind="stable")[:k]]
            found.append((np.full(len(some), q), some, score[some]))
        yield tuple(np.concatenate(x) for x in zip(*found))
