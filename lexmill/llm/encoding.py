"""Garbled text from wrong character encodings.

A smoothed character n-gram model is trained on clean values. Each word that could have been decoded wrongly is run through every
chain of an encoding it may have been read in and one it may have been written in, again and again for text that was
damaged more than once; the likeliest outcome is accepted if it beats the word as it stands, and the word with its
look-alike letters folded (which is another problem), by a margin. Margins are validated on held-out words: words fall into folds, and
each is judged by a model that never saw it in any letter case. A word of another single-byte reading must beat a lower margin if it stands in the clean text at
least as often as the word itself, the validated one if not: a letter that fits better proves little for a name that is met once.

UTF-8 that was read as something else is restored sequence by sequence, so partly damaged words and cut sequences do not
hide the rest. Characters that are lost (replacement and C1 control characters) are a candidate too, the word without them; it can
be found but not restored.

Null and empty values are never affected. Ids may repeat; each row is judged by itself. Further columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.charmodel import CharModel, train

#: Encodings that text was read in.
READ_IN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866")
#: Further ones that UTF-8 was read in.
SEQUENCES_READ_IN = (*READ_IN, "cp1253", "cp1254")
#: Single- and double-byte encodings that text was written in.
WRITTEN_IN = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8-r", "cp866", "shift_jis", "euc_jp", "gbk", "big5")
#: Words from this length on are restored as arrays.
LONG = 64
#: Rounds of repair, one for each time that a value was damaged.
ROUNDS = 4
#: Lower bounds of the margins for sequences, for other chains and for lost characters; the share of held-out words that may pass; bins of a
#: gain of one, in which they are counted.
LEAST_MARGINS, PASSING, BINS = (1.0, 40.0, 1.0), 0.0003, 1_000
#: Gain from which another reading is taken that stands in the text as often as the word itself.
ATTESTED = 4.0
#: So much oftener than the word must another reading stand in the text to be taken for less than the margin.
OFTENER = 20.0
#: What it costs a sequence to stand for a character that the clean text never holds: of alphabets, of scripts with thousands of characters.
NEW_CHARACTER, NEW_SIGN = 20.0, 6.0
#: Gain from which a sequence is taken whatever the counts; below it a word that is met oftener than SELDOM times must not be commoner than what
#: it would stand for, as an apostrophe or a quotation mark beside a letter may look like a sequence in every copy of a common word.
SURE, SELDOM = 10.0, 2

_LOST = re.compile("[\x80-\x9f�]")
_WORD = re.compile("[^ \t\n\r]*[^\x00-\x7f][^ \t\n\r]*")
_SEQUENCE = re.compile(b"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_SPACES = re.compile("[\xa0\u2000-\u200a\u202f\u3000\x80-\x9f]")
_BOXES = re.compile("[\u2500-\u25a0\uff61-\uff9f]")
_HIGH_RUN = re.compile("[^\x00-\x7f]{2,}")
_TWO_HIGH = re.compile("[^\x00-\x7f]{2}")
_EAST = re.compile("[\u3001-\u30ff\u3400-\u9fff\uff01-\uff60]")
_MIXED_RUN = re.compile("[!-\u024f\u02c6-\u02dd\u03c0\u2010-\u22ff\u25ca\ufb01\ufb02]{4,}")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
_FAR_BESIDE = re.compile("[Ѐ-ԯ][\u0530-\u1cff\u2300-\U0003ffff]|[\u0530-\u1cff\u2300-\U0003ffff][Ѐ-ԯ]")
#: Scripts that none of READ_IN can write: words wholly in them are no candidates.
_OTHER_SCRIPTS = re.compile("[\x00-\x7f֐-῿⺀-꓿가-퟿＀-￯]*")


@lru_cache(None)
def _byte_of(encoding: str):
    """A quick table of the byte that each character stands for in a text that was read in that encoding."""
    return codecs.charmap_build("".join(map(chr, range(0x80))) + "".join(_read_as(b, encoding) for b in range(0x80, 0x100)))


def _read_as(byte: int, encoding: str) -> str:
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return chr(byte)


#: Mixed readings in cp1252: control characters stand for their own bytes.
_CONTROLS = range(0x80, 0xA0)
_MIXED = {ord(_read_as(b, "cp1252")) if b >= 0x80 else b: b for b in range(0x100)} | {b: b for b in _CONTROLS}


def _mapped(word: str, encoding: str, errors: str) -> bytes:
    table = _MIXED if encoding == "cp1252" and _LOST.search(word) else _byte_of(encoding)
    return codecs.charmap_encode(word, errors, table)[0]


def _as_bytes(word: str, encoding: str) -> bytes | None:
    try:
        return _mapped(word, encoding, "strict")
    except UnicodeEncodeError:
        return None


def _utf8_back(word: str, encoding: str) -> str | None:
    """The word with all its UTF-8 sequences, as read in that encoding, restored."""
    return _restored(word, _mapped(word, encoding, "replace"))


def _restored(word: str, mapped: bytes) -> str | None:
    out, at, changed = [], 0, False
    for m in _SEQUENCE.finditer(mapped):
        try:
            restored = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[at : m.start()], restored]
        at, changed = m.end(), True
    return "".join([*out, word[at:]]) if changed else None


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By encoding, the byte of each character of 16 bits, '?' for those without; by byte, 1 if it continues a sequence, or the length of those it begins."""
    bytes_of = np.full((len(SEQUENCES_READ_IN), 0x10000), ord("?"), np.uint8)
    for k, read in enumerate(SEQUENCES_READ_IN):
        for b in range(0x100):
            bytes_of[k, ord(_read_as(b, read)) if b >= 0x80 else b] = b
            if read == "cp1252" and b in _CONTROLS:
                bytes_of[k, b] = b
    kinds = np.zeros(0x100, np.uint8)
    for kind, low, high in ((1, 0x80, 0xBF), (2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        kinds[low : high + 1] = kind
    return bytes_of, kinds


def _all_back(word: str) -> list[str]:
    """The different outcomes of the word over all encodings; those that read the same bytes give the same. Long words go as arrays."""
    if len(word) < LONG:
        made = {mapped: None for read in SEQUENCES_READ_IN if _SEQUENCE.search(mapped := _mapped(word, read, "replace"))}
        return [back for mapped in made if (back := _restored(word, mapped)) is not None]
    bytes_of, kinds = _tables()
    points, count = np.frombuffer((word + "   ").encode("utf-32-le", "surrogatepass"), np.uint32), len(word)
    mapped = bytes_of.take(np.minimum(points, 0xFFFF), axis=1)
    kind = kinds.take(mapped)
    on = kind == 1
    length = kind[:, :count] * on[:, 1 : count + 1]
    length *= (length < 3) | on[:, 2 : count + 2]
    length *= (length < 4) | on[:, 3:]
    outcomes: dict[str, None] = {}
    different: dict[bytes, int] = {}
    for k in np.flatnonzero((length > 1).any(axis=1)):
        different.setdefault(mapped[k].tobytes(), k)
    for own in different.values():
        made, kept, changed, data = points[:count].copy(), np.ones(count, bool), False, mapped[own]
        starts = np.flatnonzero(length[own] > 1)
        lengths = length[own, starts]
        for n, least in ((2, 0x80), (3, 0x800), (4, 0x10000)):
            at = starts[lengths == n]
            if len(at):
                point = data[at].astype(np.uint32) & (0xFF >> (n + 1))
                for i in range(1, n):
                    point = (point << 6) | (data[at + i] & 0x3F)
                good = (point >= least) & (point <= 0x10FFFF) & ((point < 0xD800) | (point > 0xDFFF))
                at, changed = at[good], changed or bool(good.any())
                made[at] = point[good]
                for i in range(1, n):
                    kept[at + i] = False
        if changed:
            outcomes[made[kept].tobytes().decode("utf-32-le", "surrogatepass")] = None
    return list(outcomes)


def shortest_back(text: str) -> str:
    """The text read in the encoding in which sequences account for most of it, restored once."""
    saved = {read: sum(map(len, found)) - len(found) for read in READ_IN if (found := _SEQUENCE.findall(_mapped(text, read, "replace")))}
    return (_utf8_back(text, max(saved, key=saved.get)) if saved else None) or text


def candidates(word: str) -> tuple[list[str], list[str]]:
    """What the word may have been: (by UTF-8 read as something else, up to ROUNDS times; by another wrong decoding).

    All outcomes of repeated damage are compared at the end, as one that was repaired halfway is no likelier than none.
    """
    sequences: dict[str, None] = {}
    if _TWO_HIGH.search(word):
        edge = [word]
        for _ in range(ROUNDS):
            edge = [back for w in edge for back in _all_back(w) if back not in sequences and back != word]
            if not edge:
                break
            edge = list(dict.fromkeys(edge))
            sequences.update(dict.fromkeys(edge))
    others: dict[str, None] = {}
    read_as: set[bytes] = set()
    for read in READ_IN:
        data = _as_bytes(word, read)
        if data is None or data in read_as:
            continue
        read_as.add(data)
        for written in WRITTEN_IN:
            if written != read:
                try:
                    others[data.decode(written)] = None
                except UnicodeDecodeError:
                    continue
    if _MIXED_RUN.search(word) and (len(word) >= 8 or _EAST.search(word)):
        for read in ("cp1252", "latin-1", "mac_roman"):
            for written in WRITTEN_IN[-4:]:
                others[_east_back(word, read, written)] = None
    others.pop(word, None)
    return [w for w in sequences if _likely_text(w) and not _torn(word, w)], [w for w in others if w not in sequences and w.isprintable() and _plausible(word, w)]


def _east_back(word: str, read: str, written: str) -> str:
    """The word with its runs of Western characters read as two-byte text, where that gives letters: parts of a text without spaces."""

    def back(m: re.Match) -> str:
        data = None if m[0].isascii() else _as_bytes(m[0], read)
        made = data.decode(written, "ignore") if data else ""
        return made if len(_EAST.findall(made)) > 0.6 * len(made) and len(made) >= 3 and not _BOXES.search(made) else m[0]

    return _MIXED_RUN.sub(back, word)


class _Kinds(dict):
    """Letters by script, as far as an encoding can confuse them."""

    def __missing__(self, c: str) -> str:
        kind = "" if not c.isalpha() else "latin" if c < "ɐ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "other" if c < "⺀" else "east"
        self[c] = kind
        return kind


_KINDS = _Kinds()


def _torn(word: str, back: str) -> bool:
    """Whether restored sequences put letters of far scripts beside Cyrillic ones: chance, as those bytes are Cyrillic letters too."""
    return bool(_CYRILLIC.search(back)) and len(_FAR_BESIDE.findall(back)) > len(_FAR_BESIDE.findall(word))


def _plausible(word: str, back: str) -> bool:
    """Whether the other reading is a word of one script that differs in a letter: a closing mark alone proves nothing."""
    kinds = set(map(_KINDS.__getitem__, back))
    kinds.discard("")
    if "east" not in kinds and (len(kinds) != 1 or len(back) != len(word)):
        return False
    found = list(map(_KINDS.__getitem__, back))
    if "east" in kinds:
        east = found.count("east")
        return (len(kinds) == 1 or (east >= 6 and east > 0.7 * (len(found) - found.count("")))) and east >= 2 and not _BOXES.search(back)
    if len(found) - found.count("") < 3 or _BOXES.search(back) or _inner_capital(back):
        return False
    changed = [i for i, (a, b) in enumerate(zip(word, back)) if a != b]
    return any(found[i] and ("".join(found[i + 1 : i + 2]) or (word[i].isalpha() and "".join(found[i - 1 : i]))) for i in changed)


def _inner_capital(word: str) -> bool:
    return any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def _likely_text(word: str) -> bool:
    """Printable but for the spaces and lost characters that a cut sequence leaves."""
    return word.isprintable() or _SPACES.sub("", word).isprintable()


@lru_cache(1 << 16)
def plain_form(word: str) -> str:
    """The word with compatibility forms and look-alike letters folded and ignorable characters gone."""
    from lexmill.llm.lookalikes import fold_word

    return fold_word(word)


def _wide_words(text: str) -> list[str]:
    """The words that are not plain ASCII; words are divided by ASCII spaces only, as others may be halves of a letter."""
    return list(filterfalse(str.isascii, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(1 << 17)
def _clean_run(run: str) -> bool:
    """Whether a run of characters beyond ASCII holds no sequence of UTF-8 in any reading."""
    return bool(_OTHER_SCRIPTS.fullmatch(run)) or not any(_SEQUENCE.search(_mapped(run, read, "replace")) for read in ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251"))


def is_clean(text: str) -> bool:
    """No trace of a wrong decoding."""
    return text.isascii() or (not _LOST.search(text) and all(map(_clean_run, _HIGH_RUN.findall(text))))


def clean_words(text: str) -> tuple[list[str], list[str], list[str]]:
    """What the model is trained on: (words that are no candidates; others without a trace of UTF-8 that was read as something else; those
    with one, which are only counted). Of a value in which most of the others have a trace nothing is learned."""
    words = text.split()
    wide = [w for w in words if not w.isascii() and _suspect(w)]
    good, traced = [], []
    for w in wide:
        (good if is_clean(w) else traced).append(w)
    if len(traced) > len(good):
        return [], [], traced
    return [w for w in words if w.isascii() or not _suspect(w)], good, traced


def _suspect(word: str) -> bool:
    return not _OTHER_SCRIPTS.fullmatch(word)


class Repairer:
    """Judges words by a model and a margin for each kind of candidate; outcomes are kept, as words come again and again."""

    def __init__(self, model: CharModel, margins: tuple[float, float, float]):
        self.model, self.margins = model, margins
        #: word: (is it affected, restored, restored if its value is affected by its other words)
        self.known: dict[str, tuple[bool, str, str]] = {}

    def gains(self, words: list[str]) -> list[list[tuple[str, float]]]:
        """For each word, by kind, its likeliest candidate and by how much it beats the word itself, plain, in small letters or with a capital."""
        lists = [(*candidates(w), [_LOST.sub("", w)] if _LOST.search(w) else []) for w in words]
        flat = [x for w, kinds in zip(words, lists) for x in (w, plain_form(w).replace(" ", "  "), w.lower(), w.capitalize(), *kinds[0], *kinds[1], *kinds[2])]
        scores = self.model.score(flat)
        out, at = [], 0
        for word, kinds in zip(words, lists):
            own = scores[at : at + 4].max()
            at += 4
            best = []
            for found in kinds:
                if found:
                    held = scores[at : at + len(found)]
                    if found is kinds[0]:
                        held = held - [self._novelty(w, word) for w in found]
                    k = int(np.argmax(held))
                    best.append((found[k], float(held[k] - own)))
                else:
                    best.append((word, -np.inf))
                at += len(found)
            out.append(best)
        return out

    def _novelty(self, back: str, word: str) -> float:
        new = self.model.new_characters(back, word)
        return sum(NEW_SIGN if c >= "\u2e80" else NEW_CHARACTER for c in new)

    def attested(self, word: str, back: str, gain: float) -> bool:
        """Does the other reading stand in the text as often as the word itself, or, where letters tell less, so much oftener?"""
        ratio = self.model.times(back) / max(self.model.times(word), 1.0)
        return ratio >= 1 and (gain > ATTESTED or (gain > LEAST_MARGINS[0] and ratio >= OFTENER))

    def judge(self, word: str, best: list[tuple[str, float]]) -> tuple[bool, str, str]:
        (sequence, a), (other, b), (_, c) = best
        if a > self.margins[0] and a - self.margins[0] >= b - ATTESTED and (a > SURE or self.model.times(word) <= max(SELDOM, self.model.times(sequence))):
            return True, sequence, sequence
        if b > self.margins[1] or self.attested(word, other, b):
            return True, other, other
        return c > self.margins[2], word, other if b > ATTESTED else word

    def learn(self, words: set[str]) -> None:
        """Find the outcome of words not met before; what is restored is judged once more, as damage of two kinds may meet."""
        if len(self.known) > 400_000:
            self.known.clear()
        now = {w: (False, w, w) for w in words if w not in self.known}
        open_words = list(now)
        for _ in range(2):
            some = [w for w in open_words if _suspect(now[w][1])]
            open_words = []
            for word, best in zip(some, self.gains([now[w][1] for w in some])):
                before = now[word]
                affected, restored, more = self.judge(before[1], best)
                now[word] = (affected or before[0], restored, more)
                if restored != before[1]:
                    open_words.append(word)
            if not open_words:
                break
        self.known |= now

    def repair_all(self, texts: list[str | None]) -> list[tuple[bool, str | None]]:
        """(affected, restored) for each text."""
        found = [[] if not t or t.isascii() else [w for w in _wide_words(t) if _suspect(w)] for t in texts]
        self.learn({w for words in found for w in words})
        out = []
        for text, words in zip(texts, found):
            hit = [w for w in words if self.known[w][0]]
            if hit:
                # beside two words of another reading the lower margin is enough to restore a third one
                more = 2 if len({w for w in hit if self.known[w][1] != w}) > 1 else 1
                text = _WORD.sub(lambda m: self.known[m[0]][more] if m[0] in self.known else m[0], text)
            out.append((bool(hit), text))
        return out


def _validated_margins(model: CharModel, words: DataFrame) -> tuple[float, ...]:
    """By kind, what clean words gain by their best wrong candidate under the model that never saw them, but for a share of PASSING; at least
    LEAST_MARGINS. Words whose other reading is attested are not counted: the lower margin holds for those. All other wide words (fold, word) count: gains
    are found in the tasks, and only counts by bin reach the driver. Nothing is clean where characters are lost, so the bound holds there."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges: dict[int, Repairer] = {}
        for batch in batches:
            found: Counter = Counter()
            by_fold: dict[int, list[str]] = {}
            for fold, word in zip(*(c.to_pylist() for c in batch.columns)):
                by_fold.setdefault(fold, []).append(word)
            for fold, some in by_fold.items():
                if fold not in judges:
                    judges[fold] = Repairer(shared.value.without(fold), LEAST_MARGINS)
                for word, best in zip(some, judges[fold].gains(some)):
                    for k, (other, gain) in enumerate(best[:2]):
                        if not (k == 1 and shared.value.times(other) >= 1):
                            found[k, int(np.floor(min(max(gain, 0.0), 1e6) * BINS))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["kind", "bin", "n"])

    rows = words.mapInArrow(count, "kind int, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).orderBy("kind", "bin").collect()
    margins = list(LEAST_MARGINS)
    for k in (0, 1):
        bins, n = np.array([r["bin"] for r in rows if r["kind"] == k]), np.array([r["n"] for r in rows if r["kind"] == k])
        if len(bins):
            at = (1 - PASSING) * (n.sum() - 1)
            low, high = (bins[np.searchsorted(np.cumsum(n), int(x), side="right")] / BINS for x in (np.floor(at), np.ceil(at)))
            margins[k] = max(margins[k], float(low + (high - low) * (at - np.floor(at))))
    return tuple(margins)


def fit(df: DataFrame, id_col: str, fields: list[str]) -> Repairer:
    """Train on the clean words of all values of the fields and validate the margins on each of them, as if never met."""
    values = None
    for field in fields:
        some = df.select(F.col(field).cast("string").alias("value")).where("value is not null")
        values = some if values is None else values.union(some)
    model, words = train(values, clean_words)
    return Repairer(model, _validated_margins(model, words))


def repaired(df: DataFrame, id_col: str, fields: list[str], repairer: Repairer | None = None) -> DataFrame:
    """(id, field, affected, restored) for each value of the fields that is not null."""
    repairer = repairer or fit(df, id_col, fields)
    shared = df.sparkSession.sparkContext.broadcast((repairer.model, repairer.margins))
    names = list(fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Repairer(*shared.value)
        for batch in batches:
            for k, name in enumerate(names):
                values = batch.column(k + 1).to_pylist()
                some = [i for i, v in enumerate(values) if v is not None]
                done = mine.repair_all([values[i] for i in some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some, pa.int64())), pa.array([name] * len(some), pa.string()), pa.array([a for a, _ in done], pa.bool_()), pa.array([t for _, t in done], pa.string())],
                    names=["id", "field", "affected", "restored"],
                )

    picked = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).alias(f"value_{k}") for k, f in enumerate(fields)])
    return picked.mapInArrow(judge, "id long, field string, affected boolean, restored string")
