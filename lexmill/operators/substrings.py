"""The k best documents for many queries at once by how often the queries' terms stand in them as substrings.

Documents come in parts; those of a part stand in blocks of similar ones, and a block is looked into only for queries for which the most that
its documents hold of each term could add up to what the k-th best document has. No document is left out that belongs to the result. Scores are
whole numbers, so sums are exact, in single precision too as long as no bound is beyond 2^24.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of (term, document) that are held at once, and of (query, document) or (query, block) that are summed up at once.
_CELLS, _SUMS = 4_000_000, 250_000
#: Queries that are looked at together; documents of a block and blocks of a wide one.
_ROWS, _BLOCK, _WIDE = 8_192, 16, 32
#: Words whose terms are remembered; hits that wait to be merged.
_WORDS, _WAITING = 500_000, 1_000_000


class _Words(dict):
    """Numbers of words, in the order in which they are met; the terms inside each new one are found once, as a term holds no blank."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.place = {t: i for i, t in enumerate(terms)}
        self.sizes = sorted({len(t) for t in terms})
        self.found: list[int] = []
        self.times: list[int] = []
        self.ends = [0]

    def __missing__(self, word: str) -> int:
        parts = {word[i : i + n] for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1)}
        for t in parts:
            if (i := self.place.get(t)) is not None:
                self.found.append(i)
                self.times.append(word.count(t))
        self.ends.append(len(self.found))
        self[word] = len(self.ends) - 2
        return self[word]


class Counts:
    """How often terms stand in texts."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = _Words(terms)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, document, times); a pair can come more than once."""
        if len(self.words) > _WORDS:
            self.words = _Words(self.terms)
        split = [t.lower().split() for t in texts]
        number = np.array([self.words[w] for words in split for w in words], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        ends, found, times = (np.array(x, np.int64) for x in (self.words.ends, self.words.found, self.words.times))
        sizes = (ends[1:] - ends[:-1])[number]
        at = np.arange(sizes.sum()) + np.repeat(ends[number] - np.cumsum(sizes) + sizes, sizes)
        return found[at], np.repeat(doc, sizes), times[at]


class _Part:
    """Counts of a part's documents by term, in blocks of documents that hold about as much of what the queries ask for."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, times: np.ndarray, documents: int, terms: int, asked: np.ndarray):
        here = np.zeros(terms, bool)
        here[term] = True
        present = np.flatnonzero(here)
        #: The row of each term; the last row is of those that no document holds.
        self.row = np.full(terms + 1, len(present), np.int64)
        self.row[present] = np.arange(len(present))
        wide = _BLOCK * _WIDE
        padded = -(-documents // wide) * wide
        counts = np.bincount(self.row[term] * documents + doc, times, (len(present) + 1) * documents).reshape(-1, documents)
        self.order = np.argsort(-(asked[present] @ counts[:-1]), kind="stable")
        full = np.zeros((len(counts), padded))
        full[:, :documents] = counts[:, self.order]
        self.most = np.append(full.max(axis=1), 0.0)
        self.documents = documents
        self.levels = full.reshape(len(full), 1, -1, wide).max(axis=3), full.reshape(len(full), -1, _WIDE, _BLOCK).max(axis=3), full.reshape(len(full), -1, _BLOCK)

    def exact(self, bound: float) -> None:
        """Take single precision where sums up to bound are exact in it."""
        if bound < 1 << 24:
            self.levels = tuple(x.astype(np.float32) for x in self.levels)

    def sums(self, level: int, at: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """For each pair of a query and a column of the level what its members hold of the query's terms at most."""
        values = self.levels[level]
        flat = values.reshape(-1, values.shape[2])
        total = np.zeros((len(rows), values.shape[2]), values.dtype)
        of, weight = at[rows] * values.shape[1] + cols[:, None], weight[rows]
        for j in range(at.shape[1]):
            held = flat.take(of[:, j], axis=0)
            if weight[:, j].max(initial=0) > 1:
                held *= weight[:, j, None].astype(values.dtype)
            total += held
        return total


class Best:
    """The k best of all documents that were met. asked: (starts, term, weight), the terms of each query from its start on, a weight how often it
    stands there; floor: a bound that the k-th best score of each query is known to reach."""

    def __init__(self, terms: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, floor: np.ndarray | None = None):
        starts, term, weight = asked
        self.terms, self.k, self.met = terms, k, 0
        sizes = np.diff(starts)
        self.asked = np.bincount(term, weight, terms)
        self.floor = np.zeros(len(sizes)) if floor is None else floor.copy()
        self.slabs = []
        order = np.argsort(sizes, kind="stable")
        for rows in (order[low : low + _ROWS] for low in range(0, len(order), _ROWS)):
            own, width = sizes[rows], int(sizes[rows].max(initial=0))
            if width:
                row, place = np.repeat(np.arange(len(rows)), own), np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                terms_of, weights = np.full((len(rows), width), terms, np.int32), np.zeros((len(rows), width), np.int32)
                terms_of[row, place], weights[row, place] = term[starts[rows][row] + place], weight[starts[rows][row] + place]
                self.slabs.append((rows, terms_of, weights))
        self.hits: list[tuple] = []
        self.waiting, self.kept = 0, 0

    def parts(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], documents: int) -> Iterator[tuple[_Part, int]]:
        """The documents in parts of few enough cells, with the number of documents before each."""
        term, doc, times = counts
        step = max(1, _CELLS // (min(self.terms, len(term)) + 1))
        for low in range(0, documents, step):
            here = (doc >= low) & (doc < low + step) if step < documents else slice(None)
            count = min(step, documents - low)
            part = _Part(term[here], doc[here] - low, times[here], count, self.terms, self.asked)
            part.exact(max((float((weight * part.most[part.row[of]]).sum(axis=1).max()) for _, of, weight in self.slabs), default=0.0))
            yield part, low

    def floors(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], documents: int, hidden: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The k-th best score of each query among these documents, 0 if there are fewer; hidden: (query, document) that take no part."""
        most = np.zeros((len(self.floor), self.k))
        for part, low in self.parts(counts, documents):
            place = np.empty(part.documents, np.int64)
            place[part.order] = np.arange(part.documents)
            there = (hidden[1] >= low) & (hidden[1] < low + part.documents)
            hidden_q, hidden_doc = hidden[0][there], place[hidden[1][there] - low]
            blocks = part.levels[2].shape[1]
            step = max(1, _SUMS // (blocks * _BLOCK))
            for rows, of, weight in self.slabs:
                at = part.row[of]
                for begin in range(0, len(rows), step):
                    own = np.arange(begin, min(begin + step, len(rows)))
                    scores = part.sums(2, at, weight, np.repeat(own, blocks), np.tile(np.arange(blocks), len(own))).reshape(len(own), -1)
                    if len(hidden_q):
                        row = np.full(len(self.floor), -1)
                        row[rows[own]] = np.arange(len(own))
                        some = row[hidden_q] >= 0
                        scores[row[hidden_q[some]], hidden_doc[some]] = 0
                    both = np.concatenate([most[rows[own]], scores], axis=1)
                    most[rows[own]] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        return most.min(axis=1)

    def meet(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], documents: int, hidden: tuple[np.ndarray, np.ndarray]) -> None:
        """Take in further documents, in the order of ties, which get the next numbers; hidden: (query, document of these) that take no part."""
        for part, low in self.parts(counts, documents):
            hide = np.sort(hidden[0] * documents + hidden[1])
            for rows, of, weight in self.slabs:
                at = part.row[of]
                bounds = part.sums(0, at, weight, np.arange(len(rows)), np.zeros(len(rows), np.int64))
                row, wide = np.nonzero(bounds >= np.maximum(self.floor[rows], 1)[:, None])
                self._blocks(part, low, rows, at, weight, row, wide, hide, documents)
            self._merge()
            # documents met later are behind these in ties
            full = self.full
            self.floor[full[0]] = np.maximum(self.floor[full[0]], full[1] + 1)
        self.met += documents

    def _blocks(self, part: _Part, low: int, rows: np.ndarray, at: np.ndarray, weight: np.ndarray, row: np.ndarray, wide: np.ndarray, hide: np.ndarray, documents: int) -> None:
        step, narrow = _SUMS // _WIDE, _SUMS // _BLOCK
        for begin in range(0, len(row), step):
            r, w = row[begin : begin + step], wide[begin : begin + step]
            bounds = part.sums(1, at, weight, r, w)
            pair, place = np.nonzero(bounds >= np.maximum(self.floor[rows[r]], 1)[:, None])
            r, block = r[pair], w[pair] * _WIDE + place
            for start in range(0, len(r), narrow):
                some, cols = r[start : start + narrow], block[start : start + narrow]
                scores = part.sums(2, at, weight, some, cols)
                hit, col = np.nonzero(scores >= np.maximum(self.floor[rows[some]], 1)[:, None])
                q, doc, score = rows[some[hit]], low + part.order[cols[hit] * _BLOCK + col], scores[hit, col].astype(float)
                if len(hide) and len(q):
                    key = q * documents + doc
                    open_ = hide[np.minimum(np.searchsorted(hide, key), len(hide) - 1)] != key
                    q, doc, score = q[open_], doc[open_], score[open_]
                self.hits.append((q, self.met + doc, score))
                self.waiting += len(q)
                if self.waiting - self.kept > _WAITING:
                    self._merge()

    def _merge(self) -> None:
        """Keep the k best of each query; a query that has as many gets their least score as its floor."""
        q, doc, score = (np.concatenate(x) for x in zip(*self.hits)) if self.hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.full = q[last], score[last]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        kept = place < self.k
        self.hits = [(q[kept], doc[kept], score[kept])]
        self.waiting = self.kept = int(kept.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the best, by query."""
        self._merge()
        return self.hits[0]
