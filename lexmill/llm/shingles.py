"""Word shingles as 64-bit hashes, and DartMinHash signatures over them, vectorised over whole Arrow batches.

A word is an unbroken run of letters and digits, letter case disregarded; a shingle is a run of five words; a text of
fewer words is one shingle. A text without any word has no shingle and is never a case.
"""

from __future__ import annotations

import functools
import math

import numpy as np

SHINGLE_WORDS = 5
_U = np.uint64
#: Odd multipliers, one for each word of a shingle.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Texts that are worked on at once: small enough for the arrays to stay in the cache, and for a text's number to fit in 8 bits.
CHUNK = 256
_TABLE = 0x32000
_base = _U(0x5851F42D4C957F2D)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """By code point: is it a letter or digit, and 64 random bits; powers of the base and of its inverse, grown on demand."""
    alnum = np.fromiter((chr(i).isalnum() for i in range(_TABLE)), bool, _TABLE)
    alnum[0xD800:0xE000] = False
    return alnum, mix(np.arange(_TABLE, dtype=_U) + _U(0x2545F4914F6CDD1D)), [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _tables()[2]
    if len(held[0]) < n:
        inverse = _U(pow(int(_base), -1, 1 << 64))
        held[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(n * 2, x, _U))]) for x in (_base, inverse)]
    return held[0], held[1]


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text: (flat hashes of 56 bits, sorted within a text; offsets of length len(texts) + 1)."""
    flats, sizes = [], []
    for low in range(0, len(texts), CHUNK):
        flat, n = _chunk(texts[low : low + CHUNK])
        flats.append(flat)
        sizes.append(n)
    if not flats:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    return np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _chunk(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    docs = len(texts)
    lowered = [(text or "").lower() for text in texts]
    joined = "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    alnum, bits, _ = _tables()
    high = points >= _TABLE
    points = np.where(high, 0x31FFF, points) if high.any() else points
    inside = alnum[points]
    if high.any():
        inside |= high & np.fromiter((len(c) and c.isalnum() for c in joined), bool, len(points))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(docs, np.int64)
    up, down = _powers(len(points) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(bits[points] * up[: len(points)], dtype=_U)])
    words = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(_U))
    counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=docs)
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(docs), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
    words = np.concatenate([words, np.zeros(SHINGLE_WORDS, _U)])
    short = counts < SHINGLE_WORDS
    value = np.zeros(len(at), _U)
    for j in range(SHINGLE_WORDS):
        part = (words[at + j] + _U(j + 1)) * _MULTIPLIERS[j]
        if short.any():
            part[short[doc] & (j >= counts[doc])] = 0
        value += part
    # One sort of plain integers: the text's number in the upper bits, 56 bits of the shingle's hash below.
    keyed = np.sort((mix(value) >> _U(8)) | (doc.astype(_U) << _U(56)))
    keep = np.ones(len(keyed), bool)
    keep[1:] = keyed[1:] != keyed[:-1]
    keyed = keyed[keep]
    return keyed & _U((1 << 56) - 1), np.bincount((keyed >> _U(56)).astype(np.int64), minlength=docs)


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set that do not depend on order; equal sets have equal fingerprints."""
    sizes = np.diff(offsets)
    out = []
    for salt in (_U(0x51ED270B9F3A1C55), _U(0x7F4A7C159E3779B9)):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(flat ^ salt), dtype=_U)])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(_U)).astype(np.int64))
    return out[0], out[1]


def _poisson_counts() -> np.ndarray:
    """Darts in a region of area one, by the upper 16 bits of the region's hash."""
    table, total, p = np.zeros(1 << 16, np.int64), 0.0, math.exp(-1)
    for n in range(20):
        low, total, p = total, total + p, p / (n + 1)
        table[round(low * 65536) : round(total * 65536)] = n
    return table


_COUNTS = _poisson_counts()


def dart_min_hash(flat: np.ndarray, offsets: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: k values for each weighted set; two sets agree in a coordinate with a probability of their weighted Jaccard similarity.

    The plane above each element, weight across and rank upwards, is cut into regions of area one. A region's hash tells
    how many darts fall into it; each dart has a place in it and one of k coordinates. A set sees the darts whose weight
    lies below the element's and whose rank lies below t / total weight, with t about k ln k + 3 k, and keeps the earliest
    of each coordinate. Sets that leave a coordinate empty throw again with twice the ranks, so no value is made up.
    Without weights each element weighs one. An empty set has zeros.
    """
    docs = len(offsets) - 1
    out = np.zeros((docs, k), _U)
    weights = np.ones(len(flat)) if weights is None else np.asarray(weights, float)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    totals = np.bincount(owner, weights=weights, minlength=docs)
    todo = np.flatnonzero(totals > 0)
    t = k * math.log(k) + 3 * k
    step = CHUNK
    while len(todo):
        empty = []
        for low in range(0, len(todo), step):
            some = todo[low : low + step]
            got = _throw(flat, offsets, weights, totals, some, k, t)
            full = (got != np.iinfo(np.uint64).max).all(axis=1)
            out[some[full]] = got[full]
            empty.append(some[~full])
        todo, t = np.concatenate(empty), 2 * t
    return out


def _throw(flat, offsets, weights, totals, docs, k, t):
    sizes = offsets[docs + 1] - offsets[docs]
    slot = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(slot)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[docs][slot]
    ceiling = t / totals[docs]
    ranks = np.ceil(ceiling).astype(np.int64)[slot]
    columns = np.ceil(weights[at]).astype(np.int64)
    cells = ranks * columns
    element = np.repeat(np.arange(len(at)), cells)
    number = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, rank = np.divmod(number, ranks[element])
    region = mix(flat[at][element] + rank.astype(_U) * _U(0x9E3779B97F4A7C15) + column.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    thrown = _COUNTS[(region >> _U(48)).astype(np.int64)]
    which = np.repeat(np.arange(len(region)), thrown)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    dart = mix(region[which] + (nth.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
    rank, element = rank[which], element[which]
    height = (rank.astype(_U) << _U(32)) | (dart >> _U(32))
    inside = height <= (ceiling * 4294967296.0).astype(_U)[slot[element]]
    if (columns > 1).any() or (weights[at] < 1).any():
        across = column[which] + (mix(dart) >> _U(40)).astype(float) / (1 << 24)
        inside &= across <= weights[at][element]
    coordinate = ((dart & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64)
    got = np.full(len(docs) * k, np.iinfo(np.uint64).max, _U)
    np.minimum.at(got, (slot[element] * k + coordinate)[inside], height[inside])
    return got.reshape(len(docs), k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is mixed in, so that keys of different bands never meet."""
    docs = len(signatures)
    parts = signatures[:, : bands * rows].reshape(docs, bands, rows)
    key = np.zeros((docs, bands), _U) + (np.arange(bands, dtype=_U) + _U(1)) * _MULTIPLIERS[0]
    for r in range(rows):
        key = mix(key + parts[:, :, r] * _MULTIPLIERS[1 + r % 4])
    return key.astype(np.int64)
