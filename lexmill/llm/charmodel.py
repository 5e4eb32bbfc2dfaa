"""A smoothed character trigram model in tables of fixed size, trained over whole tables and scored over whole batches.

Code points are hashed into tables of 2^18 pairs, 2^20 triples and, for words that are not plain ASCII, 2^22 words, so the model has the same size whatever the corpus;
what reaches the driver and the executors is bounded by that. P(c | a, b) = (n(abc) + s q(c)) / (n(ab) + s) with q from
single characters. Words stand between two spaces each; digits count as one character.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize

POINTS, PAIRS, TRIPLES = 0x32000, 1 << 18, 1 << 20
#: Slots for the number of times that each word that is not plain ASCII stands in the text.
WORDS = 1 << 22
SIZE = POINTS + PAIRS + TRIPLES + WORDS
#: Words that are not plain ASCII fall into this many folds, so that each can be judged by a model that never saw it.
FOLDS = 4
SMOOTHING = 2.0
_U = np.uint64
_NO_LETTER = re.compile(r"[\W_]+")


def word_number(word: str) -> int:
    """A hash of the word without signs and letter case."""
    return zlib.crc32(_NO_LETTER.sub("", word.casefold()).encode("utf-8", "surrogatepass"))


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    points[points >= POINTS] = POINTS - 1
    points[(points >= 48) & (points <= 57)] = 48
    return points


def _slots(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the pair before each character from the third on, and of the triple that ends with it."""
    pair = (p[:-2] * _U(0x9E3779B97F4A7C15) + p[1:-1] * _U(0xC2B2AE3D27D4EB4F)) * _U(0xD6E8FEB86659FD93)
    triple = (pair ^ (p[2:] * _U(0xA0761D6478BD642F))) * _U(0xE7037ED1A0B428DB)
    return (pair >> _U(46)).astype(np.int64), (triple >> _U(44)).astype(np.int64)


def _add(total: np.ndarray, words: list[str]) -> None:
    p = _points("  " + "  ".join(words) + "  ")
    pair, triple = _slots(p)
    for offset, slots, size in ((0, p.astype(np.int64), POINTS), (POINTS, pair, PAIRS), (POINTS + PAIRS, triple, TRIPLES)):
        total[offset : offset + size] += np.bincount(slots, minlength=size)


def train(values: DataFrame, pick: Callable[[str], tuple[list[str], list[str], list[str]]]) -> tuple["CharModel", DataFrame]:
    """(a model over the one column of values; the different wide words, (fold, word)). pick tells which words of a value that is not
    ASCII count, as (plain ones, wide ones, traced ones): wide ones are counted by fold and as words too, traced ones as words only.

    One pass: tasks add up counts by slot, those of wide words by fold too, and name their wide words once each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wide, traced = np.zeros(POINTS + PAIRS + TRIPLES, np.int64), Counter(), Counter()
        for batch in batches:
            plain: list[str] = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                if text.isascii():
                    plain += text.split()
                else:
                    more, special, odd = pick(text)
                    plain += more
                    wide.update(special)
                    traced.update(map(word_number, odd))
                if len(plain) > 20_000:
                    _add(total, plain)
                    plain = []
            if plain:
                _add(total, plain)
            if len(wide) > 100_000:
                yield from emitted(None, wide)
                wide = Counter()
        yield from emitted(total, wide)
        if traced:
            numbers = np.array(list(traced))
            yield rows(-1, *_summed([POINTS + PAIRS + TRIPLES + numbers // FOLDS % WORDS], [np.array(list(traced.values()))]))

    def emitted(total: np.ndarray | None, wide: Counter) -> Iterator[pa.RecordBatch]:
        if total is not None:
            some = np.flatnonzero(total)
            yield rows(-1, some, total[some])
        numbers = {w: word_number(w) for w in wide}
        for fold in range(FOLDS):
            own = [w for w in wide if numbers[w] % FOLDS == fold]
            if own:
                slots, times = [], []
                for low in range(0, len(own), 2_000):
                    part = own[low : low + 2_000]
                    p = _points("  " + "  ".join(part) + "  ")
                    pair, triple = _slots(p)
                    slots += [p[2:].astype(np.int64), POINTS + pair, POINTS + PAIRS + triple, POINTS + PAIRS + TRIPLES + np.array([numbers[w] // FOLDS % WORDS for w in part])]
                    each = np.array([wide[w] for w in part])
                    times += [np.repeat(each, [len(w) + 2 for w in part])] * 3 + [each]
                yield rows(fold, *_summed(slots, times))
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(own), pa.int32()), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int64()), pa.array(own, pa.string())], names=["fold", "slot", "n", "word"])

    def rows(fold: int, slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), fold), pa.int32()), pa.array(slots, pa.int32()), pa.array(n, pa.int64()), pa.nulls(len(slots), pa.string())], names=["fold", "slot", "n", "word"])

    made = materialize(values.mapInArrow(count, "fold int, slot int, n long, word string"), "characters")
    counted = made.where("slot is not null").groupBy("fold", "slot").agg(F.sum("n").alias("n")).toPandas()
    folds = {fold: (part["slot"].to_numpy(), part["n"].to_numpy()) for fold, part in counted.groupby("fold")}
    return CharModel(folds), made.where("word is not null").select("fold", "word").distinct()


class CharModel:
    """Counts by slot: (slots, counts) for plain words (-1) and for the words of each fold."""

    def __init__(self, folds: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.folds = folds
        counts = np.zeros(SIZE, np.float32)
        for slots, n in folds.values():
            counts[slots] += n
        self._take(counts)

    def _take(self, counts: np.ndarray) -> None:
        single = counts[:POINTS] + np.float32(0.05)
        self.single = single / single.sum()
        self.least = self.single.min()
        self.pairs = counts[POINTS : POINTS + PAIRS]
        self.triples = counts[POINTS + PAIRS : POINTS + PAIRS + TRIPLES]
        self.words = counts[POINTS + PAIRS + TRIPLES :]

    def __reduce__(self):
        return CharModel, (self.folds,)

    def without(self, fold: int) -> "CharModel":
        """The model that never saw the words of a fold."""
        return CharModel({f: part for f, part in self.folds.items() if f != fold})

    def times(self, word: str) -> float:
        """How often the word, but for signs and letter case, stands in the text."""
        return float(self.words[word_number(word) // FOLDS % WORDS])

    def new_characters(self, word: str, other: str) -> list[str]:
        """The characters of the word, but for those of the other one, that the text never holds."""
        return [c for c in set(word).difference(other) if self.single[min(ord(c), POINTS - 1)] <= self.least]

    @classmethod
    def joined(cls, *models: "CharModel") -> "CharModel":
        """One model over all that several were trained on."""
        folds: dict[int, list] = {}
        for m in models:
            for fold, part in m.folds.items():
                folds.setdefault(fold, []).append(part)
        return cls({fold: _summed(*zip(*parts)) for fold, parts in folds.items()})

    def score(self, words: list[str]) -> np.ndarray:
        """The log-likelihood of each word, between spaces."""
        if not words:
            return np.zeros(0)
        p = _points("  " + "  ".join(words) + "  ")
        pair, triple = _slots(p)
        each = np.log((self.triples[triple] + SMOOTHING * self.single[p[2:].astype(np.int64)]) / (self.pairs[pair] + SMOOTHING))
        sums = np.concatenate([[0.0], np.cumsum(each, dtype=float)])
        lengths = np.array([len(w) for w in words]) + 2
        ends = np.cumsum(lengths)
        # of the two spaces behind a word the first tells that it ends
        return sums[ends - 1] - sums[ends - lengths]


def _summed(slots: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different slots with their sums."""
    different, at = np.unique(np.concatenate(slots), return_inverse=True)
    return different, np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
