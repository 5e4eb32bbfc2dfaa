"""Subject areas of documents: term weighting, truncated singular value decomposition, cosine to refined seed centroids.

1. One pass turns each text into hashed terms by sentence (words; pairs of characters in scripts without spaces) and tells its
   language by script and function words. A text that was decoded wrongly is read as what it said, as far as its sequences show.
2. Terms are weighted by rarity and by how unevenly they fall on subjects, as labels and categories suggest.
3. For each language documents are decomposed: a randomised range of the term-document matrix, one power iteration, the leading
   singular vectors. Tasks emit sums of fixed size, whatever the number of documents.
4. Seed centroids come from the sentences of labelled documents and of those whose category points to a subject; they are
   refined by assigning all sentences and taking the mean of what is assigned clearly.
5. A record's subjects are those that take about a quarter of its sentences, weighted by length. The category has no say here.

At most MOST_LABELS labelled rows are used, in hash order of their id; everything else covers all rows. More than MOST_SUBJECTS subjects are an error. Null, empty and term-less
texts have no subject. Repeated rows get their rows each. Further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import encoding
from lexmill.llm import shingles as S
from lexmill.storage import materialize

MOST_LABELS, MOST_SUBJECTS = 50_000, 1_000
#: Slots for the terms of a language; leading vectors, and further ones for the random range.
SLOTS, RANK, OVERSAMPLE = 1 << 14, 40, 8
REFINEMENTS = 2
#: Terms of less than this share of the largest weight are stop words: they have none.
STOP = 0.001
#: Documents that are projected at once: few enough for their vectors to stay in the cache.
SLICE = 200
#: A sentence counts for the nearest centroid from this cosine, and this much nearer than to the next.
NEAR, CLEAR = 0.15, 0.02
#: Share of a text's decided sentences that makes a subject; decided share of all that a text must have.
QUARTER, DECIDED = 0.2, 0.15

# Languages told by script, and function words of those that share one.
LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "ar", "fa", "hi", "th", "ja", "zh", "xx")
FUNCTION_WORDS = {
    "en": "the of and in was were to from for with on that by at",
    "de": "der die das und von bei mit für sich nicht um wurde am wie",
    "fr": "le les des est dans une du sur par la que et ne pas plus",
    "es": "el los las que del una con por se no al más en dijo",
    "pt": "o os as não uma em com do da na se também que ao",
    "fa": "در را از که است این با می آن بود",
    "ar": "في من على إلى عن كان هل لم بين ثم",
}
_CLASSES = ((0x41, 0x24F, 1), (0x400, 0x52F, 2), (0x600, 0x6FF, 3), (0x900, 0x97F, 4), (0xE00, 0xE7F, 5), (0x3041, 0x30FF, 6), (0x3400, 0x9FFF, 7))


@lru_cache(1)
def _tables():
    alnum, bits, _ = S._tables()
    kind = np.zeros(S._TABLE, np.int8)
    for low, high, k in _CLASSES:
        kind[low : high + 1] = k
    kind[~alnum[: S._TABLE] & (kind < 4)] = 0
    stop = np.zeros(S._TABLE, bool)
    for c in ".!?。！？।؟\n":
        stop[ord(c)] = True
    spoken = {}
    for name, words in FUNCTION_WORDS.items():
        for word in words.split():
            spoken.setdefault(_word_hash(word), LANGUAGES.index(name))
    keys = np.array(sorted(spoken), np.uint64)
    return alnum, bits, kind, stop, keys, np.array([spoken[int(k)] for k in keys])


def _word_hash(word: str) -> int:
    points = np.array([ord(c) for c in word])
    up, _ = S._powers(len(points) + 1)
    total = (S._tables()[1][points] * up[: len(points)]).sum(dtype=np.uint64)
    return int(S.mix(np.array([total + np.uint64(len(points))], np.uint64))[0])


_HIGH_LATIN = re.compile("[\x80-\u024f]")


def readable(text: str) -> str:
    """Small letters in compatibility form; sequences of UTF-8 that was read as something else are restored."""
    if text.isascii():
        return text.lower()
    if not encoding.is_clean(text):
        for _ in range(encoding.ROUNDS):
            best = encoding.shortest_back(text)
            if len(text) - len(best) < 0.02 * len(text):
                break
            text = best
    if len(text.encode("utf-8", "surrogatepass")) > 1.4 * len(text) and len(_HIGH_LATIN.findall(text)) > 0.4 * len(text):  # two-byte text that was read as one-byte text
        data = encoding._as_bytes(text, "cp1252")
        backs = [data.decode(e, "ignore") for e in ("gbk", "shift_jis", "euc_jp", "big5", "koi8-r", "cp1251")] if data else []
        text = max([text, *backs], key=lambda b: sum(c in "的一是不了在有我这个和中大为上の、。をにはがとでたвоиаен" for c in b) / max(len(b), 1))
    return unicodedata.normalize("NFKC", text).lower()


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(language of each text; flat (text, sentence, slot) of all terms as three rows)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points >= S._TABLE, 0, points)
    alnum, bits, kind, stop, keys, spoken = _tables()
    kinds = kind[points]
    wide = kinds >= 5
    word = alnum[points] | (kinds == 4)
    word &= ~wide
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = S._powers(len(points) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(bits[points] * up[: len(points)], dtype=np.uint64)])
    hashed = S.mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    pairs = np.flatnonzero(wide[:-1] & wide[1:])
    both = S.mix(bits[points[pairs]] * np.uint64(3) + bits[points[pairs + 1]])
    # the language: script first, function words where scripts are shared
    doc_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    scripts = np.bincount(doc_of * 8 + kinds, minlength=len(texts) * 8).reshape(len(texts), 8)
    owner = doc_of[starts]
    place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    hit = keys[place] == hashed
    said = np.bincount(owner[hit] * len(LANGUAGES) + spoken[place[hit]], minlength=len(texts) * len(LANGUAGES)).reshape(len(texts), -1)
    main = scripts[:, 1:].argmax(axis=1) + 1
    han = (main >= 6) | (scripts[:, 7] + scripts[:, 6] > 0.5 * scripts[:, 1:].sum(axis=1))
    language = np.where(main == 2, 5, np.where(main == 4, 8, np.where(main == 5, 9, 0)))
    language = np.where(main == 1, said[:, :5].argmax(axis=1), language)
    language = np.where((main == 1) & (said[:, :5].max(axis=1) == 0), 12, language)
    language = np.where(main == 3, np.where(said[:, 7] >= said[:, 6], 7, 6), language)
    language = np.where(han, np.where(scripts[:, 6] > 0.1 * (scripts[:, 6] + scripts[:, 7]), 10, 11), language)
    language = np.where(scripts[:, 1:].sum(axis=1) == 0, 12, language)
    # terms: words of at least three characters without digits in front, and pairs
    useful = (stops - starts >= 3) & (kinds[starts] > 0)
    at = np.concatenate([starts[useful], pairs])
    slot = (np.concatenate([hashed[useful], both]) >> np.uint64(50)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, slot = at[order], slot[order]
    stopped = np.cumsum(stop[points])
    return language, np.stack([doc_of[at], stopped[at], slot])


#: Slots as 16-bit numbers, term by term; the number of terms of each sentence as 32-bit ones.
_FEATURES = "id long, weak int, lang int, sizes binary, slots binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            language, (doc, sentence, slot) = _terms([readable(t) for t in part.column(2).to_pylist()])
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(sentence, prepend=-1) != 0))
            blobs = [_blobs(np.diff(np.append(first, len(doc))), np.bincount(doc[first], minlength=part.num_rows), np.uint32), _blobs(slot, np.bincount(doc, minlength=part.num_rows), np.uint16)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(language, pa.int32()), *blobs], names=["id", "weak", "lang", "sizes", "slots"])


def _blobs(flat: np.ndarray, counts: np.ndarray, kind: type) -> pa.Array:
    """Numbers as one binary value a row."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype(kind))])


def _numbers(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(flat numbers, how many each row has)."""
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _batch(batch: pa.RecordBatch):
    """(weak, lang, the text of each term, (the size, the text of each sentence), the slot of each term with its language) of a batch of features."""
    weak, lang = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
    slot, terms = _numbers(batch.column(4), np.uint16)
    sizes, pieces = _numbers(batch.column(3), np.uint32)
    doc = np.repeat(np.arange(batch.num_rows), terms)
    return weak, lang, doc, (sizes.astype(np.int64), np.repeat(np.arange(batch.num_rows), pieces)), slot.astype(np.int64) + lang[doc].astype(np.int64) * SLOTS


_SUMS = "block int, slots binary, data binary"


def _summed(features: DataFrame, function, size: int) -> dict[int, np.ndarray]:
    """Add up what tasks emit: by block a matrix of size rows, of which only those travel that are not 0.

    Blocks are added up in parallel, then one matrix for each block reaches the driver; sizes are fixed.
    """

    def gather(rows) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for block, slots, data in rows:
            at = np.frombuffer(slots, np.int32)
            values = np.frombuffer(data, np.float32).reshape(len(at), -1)
            if block not in sums:
                sums[block] = np.zeros((size, values.shape[1]), np.float32)
            sums[block][at] += values
        return sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _emit(gather(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))))

    rows = features.mapInArrow(function, _SUMS).repartition(16, "block").mapInArrow(add, _SUMS).collect()
    return gather((r.block, bytes(r.slots), bytes(r.data)) for r in rows)


def _emit(pieces: dict[int, np.ndarray]) -> pa.RecordBatch:
    blocks, slots, data = [], [], []
    for block, matrix in pieces.items():
        at = np.flatnonzero(matrix.any(axis=1))
        if len(at):
            blocks.append(block)
            slots.append(at.astype(np.int32).tobytes())
            data.append(matrix[at].astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(slots, pa.binary()), pa.array(data, pa.binary())], names=["block", "slots", "data"])


class _Rows:
    """The rows of a matrix over all slots that are not 0: what is broadcast follows the terms in use."""

    def __init__(self, matrix: np.ndarray):
        some = np.flatnonzero(matrix.any(axis=1))
        self.place = np.zeros(len(matrix), np.int32)
        self.place[some] = np.arange(1, len(some) + 1)
        self.rows = np.concatenate([np.zeros((1, matrix.shape[1]), np.float32), matrix[some].astype(np.float32)])

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return self.rows[self.place[slots]]


def _category_term(column):
    """The part of a category that may name a field: behind the source, before the domain."""
    return F.trim(F.lower(F.element_at(F.split(F.split(F.coalesce(column, F.lit("")), r"\|")[0], ":"), -1)))


def subject_table(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(ord, subject) for docs (ord, text, category), labels (ord, subject) and subjects (subject)."""
    spark = docs.sparkSession
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects: a centroid for each is held in memory")
    number = {name: k for k, name in enumerate(names)}
    count = len(names)
    picked = labels.where(F.col("subject").isin(names)).groupBy("ord").agg(F.min("subject").alias("first"), F.count_distinct("subject").alias("n"))
    picked = picked.orderBy(F.xxhash64("ord")).limit(MOST_LABELS)
    some = docs.select(F.col("ord").cast("long").alias("ord"), F.col("text"), _category_term(F.col("category")).alias("term"))
    single = some.select("ord", "term").join(picked.where("n = 1"), "ord")
    votes = single.where("term <> ''").groupBy("term", "first").agg(F.count("*").alias("n")).collect()
    by_term: dict[str, dict[str, int]] = {}
    for r in votes:
        by_term.setdefault(r.term, {})[r["first"]] = r.n
    points_to = {term: max(found, key=found.get) for term, found in by_term.items() if max(found.values()) >= max(2, 0.6 * sum(found.values()))}
    weak = F.lit(-1)
    if points_to:
        known = F.create_map(*[x for term, name in points_to.items() for x in (F.lit(term), F.lit(number[name]))])
        weak = F.coalesce(F.try_element_at(known, F.col("term")), F.lit(-1))
    labelled = picked.select("ord", F.when(F.col("n") == 1, F.element_at(F.create_map(*[x for k, v in number.items() for x in (F.lit(k), F.lit(v))]), F.col("first"))).otherwise(-1).alias("given"))
    with_weak = some.where("text is not null").join(labelled, "ord", "left").select(F.col("ord").alias("id"), F.coalesce("given", weak).cast("int").alias("weak"), "text")
    features = materialize(with_weak.mapInArrow(_features, _FEATURES), "subject-terms")
    languages, context = len(LANGUAGES), spark.sparkContext

    def frequencies(batches):
        total = np.zeros((1 + count, languages * SLOTS), np.float32)
        for batch in batches:
            weak, _, doc, _, slot = _batch(batch)
            pairs = np.unique(doc * (languages * SLOTS) + slot)
            d, s = np.divmod(pairs, languages * SLOTS)
            total[0] += np.bincount(s, minlength=languages * SLOTS)
            for k in range(count):
                own = s[weak[d] == k]
                if len(own):
                    total[1 + k] += np.bincount(own, minlength=languages * SLOTS)
        yield _emit({k: total[k][:, None] for k in range(1 + count)})

    sums = _summed(features, frequencies, languages * SLOTS)
    zeros = np.zeros((languages * SLOTS, 1), np.float32)
    seen = np.stack([sums.get(k, zeros)[:, 0] for k in range(1 + count)])
    weights = _weights(seen, count)
    shared = context.broadcast(weights)

    def vectors(batch):
        """Normalised weighted term vectors of a batch's documents, as (document, slot, value)."""
        _, lang, doc, _, slot = _batch(batch)
        some = shared.value[slot] > 0
        doc, slot = doc[some], slot[some]
        keys, n = np.unique(doc * (languages * SLOTS) + slot, return_counts=True)
        d, s = np.divmod(keys, languages * SLOTS)
        value = (1 + np.log(n)) * shared.value[s]
        norm = np.sqrt(np.bincount(d, weights=value**2, minlength=batch.num_rows))
        return lang, d, s, (value / np.maximum(norm[d], 1e-9)).astype(np.float32)

    def ranged(basis):
        def emit(batches):
            width = RANK + OVERSAMPLE
            total = np.zeros((languages * SLOTS, width), np.float32)
            for batch in batches:
                for low in range(0, batch.num_rows, SLICE):
                    part = batch.slice(low, SLICE)
                    _, d, s, v = vectors(part)
                    held = basis.value[s]
                    projected = np.zeros((part.num_rows, width), np.float32)
                    cuts = np.flatnonzero(np.diff(d, prepend=-1))
                    if len(cuts):
                        projected[d[cuts]] = np.add.reduceat(held * v[:, None], cuts, axis=0)
                    order = np.argsort(s, kind="stable")
                    at = np.flatnonzero(np.diff(s[order], prepend=-1))
                    if len(at):
                        total[s[order][at]] += np.add.reduceat(projected[d[order]] * v[order, None], at, axis=0)
            yield _emit({k: total[k * SLOTS : (k + 1) * SLOTS] for k in range(languages)})

        return emit

    width = RANK + OVERSAMPLE
    basis = np.random.default_rng(7).standard_normal((languages * SLOTS, width)).astype(np.float32) * (weights > 0)[:, None]
    for _ in range(2):
        held = context.broadcast(_Rows(basis))
        found = _summed(features, ranged(held), SLOTS)
        held.destroy()
        basis = np.zeros_like(basis)
        for k, image in found.items():
            rows = slice(k * SLOTS, (k + 1) * SLOTS)
            q, _ = np.linalg.qr(image)
            # rotated to the singular vectors within the range
            basis[rows] = q @ np.linalg.svd(q.T @ image)[0]
    space = context.broadcast(_Rows(basis[:, :RANK] * weights[:, None]))

    def sentences(batch):
        """(document, language, length, unit vector) of each sentence that has a term with weight."""
        weak, lang, _, (length, doc), slot = _batch(batch)
        if not len(slot):
            return None
        place = space.value.place[slot]
        some = np.flatnonzero(place)
        own = np.repeat(np.arange(len(length)), length)[some]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        vector = np.zeros((len(length), RANK), np.float32)
        if len(new):
            vector[own[new]] = np.add.reduceat(space.value.rows[place[some]], new, axis=0)
        norm = np.sqrt(np.einsum("ij,ij->i", vector, vector))
        return weak, doc, lang[doc], length, vector / np.maximum(norm, 1e-9)[:, None], norm > 1e-6

    def nearest(held, lang, unit):
        likeness = np.empty((len(unit), count), np.float32)
        for k in np.unique(lang):
            own = lang == k
            likeness[own] = unit[own] @ held[k].T
        best = likeness.argmax(axis=1)
        top = np.partition(likeness, -2, axis=1)[:, -2:] if count > 1 else np.stack([likeness[:, 0] - 1, likeness[:, 0]], axis=1)
        return best, top[:, 1], top[:, 1] - top[:, 0]

    def moved(held):
        def emit(batches):
            total = np.zeros((languages * count, RANK), np.float32)
            for batch in batches:
                if held is None:  # only what a label or a category speaks for
                    batch = batch.filter(pc.greater_equal(batch.column(1), 0))
                for low in range(0, batch.num_rows, SLICE):
                    made = sentences(batch.slice(low, SLICE))
                    if made is None:
                        continue
                    weak, doc, lang, _, unit, some = made
                    if held is None:
                        subject, keep = weak[doc], some & (weak[doc] >= 0)
                    else:
                        subject, like, clear = nearest(held.value, lang, unit)
                        keep = some & (like > NEAR) & (clear > CLEAR)
                    key = lang[keep] * count + subject[keep]
                    order = np.argsort(key, kind="stable")
                    at = np.flatnonzero(np.diff(key[order], prepend=-1))
                    if len(at):
                        total[key[order][at]] += np.add.reduceat(unit[keep][order], at, axis=0)
            yield _emit({0: total})

        return emit

    centroids = None
    for _ in range(1 + REFINEMENTS):
        found = _summed(features, moved(None if centroids is None else context.broadcast(centroids)), languages * count)
        raw = found.get(0, np.zeros((languages * count, RANK), np.float32)).reshape(languages, count, RANK)
        if centroids is None:
            raw = raw / np.maximum(np.linalg.norm(raw, axis=2, keepdims=True), 1e-9)
            raw = raw - 0.7 * raw.mean(axis=1, keepdims=True)
        else:
            raw = raw / np.maximum(np.linalg.norm(raw, axis=2, keepdims=True), 1e-9) + centroids
        centroids = raw / np.maximum(np.linalg.norm(raw, axis=2, keepdims=True), 1e-9)
    final = context.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                made = sentences(part)
                if made is None:
                    continue
                _, doc, lang, length, unit, some = made
                subject, like, clear = nearest(final.value, lang, unit)
                decided = some & (like > NEAR) & (clear > CLEAR)
                whole = np.bincount(doc, weights=length, minlength=part.num_rows)
                by = np.bincount(doc[decided] * count + subject[decided], weights=length[decided], minlength=part.num_rows * count).reshape(-1, count)
                enough = by.sum(axis=1) >= np.maximum(DECIDED * whole, 1)
                share = by / np.maximum(by.sum(axis=1, keepdims=True), 1e-9)
                d, s = np.nonzero((share >= QUARTER) & enough[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([names[k] for k in s], pa.string())], names=["ord", "subject"])

    return features.mapInArrow(assign, "ord long, subject string")


def _weights(seen: np.ndarray, count: int) -> np.ndarray:
    """Rarity times unevenness over subjects: 0 for terms that all subjects share alike, or that are met once."""
    documents = seen[0]
    rarity = np.log(1 + documents.sum() / len(LANGUAGES) / np.maximum(documents, 1) / 10)
    by = seen[1:] / np.maximum(seen[1:].sum(axis=1, keepdims=True), 1)
    met = seen[1:].sum(axis=0)
    share = by / np.maximum(by.sum(axis=0), 1e-12)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) / np.log(max(count, 2))
    trust = met / (met + 3.0)
    weights = (np.where(documents >= 2, rarity, 0) * np.maximum(1 - entropy, 0) ** 2 * trust).astype(np.float32)
    weights[weights < STOP * weights.max(initial=0)] = 0
    return weights
