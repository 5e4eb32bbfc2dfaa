"""Sentence boundaries across languages and scripts by a hidden-event n-gram model.

A text is cut into pieces (words; in scripts without spaces, stretches up to an end mark). Between two pieces stands a
boundary event or none. What layout shows is known: ends of paragraphs, headings, list items and lines of markup, and spaces
between Thai words; so is what lies within a quotation or a bracket. The rest is hidden: gaps behind end marks, at line breaks, at
spaces between letters of scripts that need none, and gaps before anything but a small letter in a block of UNMARKED pieces or more that
holds no end mark.

Each text is cut once; its gaps go to a table as hashed slots, over which the passes below run as array operations.

Training needs no labels. Pass 0 counts how often each piece ends or begins a known unit: pieces that never do, though they
are common, are abbreviations or stand within sentences, which shows by itself. The next passes take the events' posteriors
for expected counts of pieces, pairs of pieces before and behind the gap, and pairs across it. The last one decides with those: forward-backward over the events of a text, each smoothed from
pairs to pieces to shapes. Counts are kept in tables of 2^20 slots by hash, so the model's size does not grow.

Offsets count code points, the end is exclusive, whitespace around a sentence is left out. Null and blank texts have no
sentence; repeated rows give repeated sentences; texts of any length are taken whole. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import materialize

SLOTS = 1 << 20
#: Weight of a coarser estimate against counts: pieces against shapes, pairs against pieces, pairs across against the rest.
SHAPE_WEIGHT, PIECE_WEIGHT, ACROSS_WEIGHT = 4.0, 3.0, 5.0
#: Share of a piece's gaps that layout shows to be boundaries: at least so often if it ends sentences, so seldom if not.
OFTEN, SELDOM = 0.008, 0.0005
#: Gaps below which a piece's shape counts too; prior from which the mark alone decides pass 0.
FEW, SURE = 1_000, 0.95
#: Share of its block's width from which a line counts as wrapped; characters from which a number behind a line continues it.
FULL, LONG_LINE = 0.8, 25
#: Layout: lines of more characters were not wrapped by hand; pieces from which a block without an end mark is no heading.
WRAPPED, UNMARKED = 120, 16
#: Rounds of expected counts.
ROUNDS = 2
#: How much rarer than others a sentence of one piece is.
ONE_PIECE = 0.05

# End marks of the scripts, and what may close behind one.
_ENDS, _CLOSERS = ".!?…。！？।॥؟۔｡", "\"'”’»›)）]］」』】〉》“‟"
_PIECE = re.compile(f"[^\\s。！？｡]*[。！？｡]+[{re.escape(_CLOSERS)}]*|[^\\s。！？｡]+")
_ENDED = re.compile(f"[{re.escape(_ENDS)}]+[{re.escape(_CLOSERS)}]*$")
_WIDE_END = re.compile(f"[。！？｡]+[{re.escape(_CLOSERS)}]*$")
_MARKER = re.compile(r"[ \t]*(?:[-*•–‣·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[ \t]+\S")
_HEAD = re.compile(r"[ \t]*#{1,6}[ \t]")
_MARKUP = re.compile(r"[ \t]*<[^<>\n]*>.*>[ \t]*$|[ \t]*<[^<>\n]*>[ \t]*$")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_PAIRS = {"“": "”", "«": "»", "„": "“”", "‘": "’", "(": ")", "（": "）", "「": "」", "『": "』", "[": "]", "‹": "›", "《": "》", "【": "】", "»": "«"}
_PAIR_MARK = re.compile("[\"“”„«»‘’()（）「」『』\\[\\]‹›《》【】]")
_THAI = re.compile("[฀-๿]")
_WIDE = re.compile("[぀-ヿ㐀-鿿！-｠]")
_DIGITS = re.compile(r"\d+")
_LAST_OF_MARK = frozenset(_ENDS + _CLOSERS)


def _inside(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans of matched quotations and brackets in a paragraph, without those that lie in others."""
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _PAIR_MARK.finditer(text, start, end):
        c, at = m[0], m.start()
        closes = next((k for k in range(len(stack) - 1, -1, -1) if c in (_PAIRS.get(stack[k][0], "") if stack[k][0] != '"' else '"')), None)
        if c == "’" and at + 1 < end and text[at + 1].isalpha():
            continue
        if closes is not None:
            spans.append((stack[closes][1], at))
            del stack[closes:]
        elif c == '"' or c in "“«„‘(（「『[‹《【":
            stack.append((c, at))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for span in spans:
        if not outer or span[0] > outer[-1][1]:
            outer.append(span)
    return outer


def _normal(piece: str) -> str:
    return _DIGITS.sub("0", piece)


def _shape(piece: str, kind: str) -> str:
    """What can be said of the piece before a gap that was never met."""
    m = _ENDED.search(piece)
    body, mark = (piece[: m.start()], m[0]) if m else (piece, "")
    body = body.lstrip("\"'“«„‘(")
    size = "1" if len(body) == 1 else "s" if len(body) <= 3 else "m" if len(body) <= 5 else "l"
    case = "0" if body[-1:].isdigit() else "U" if body[:1].isupper() else "l" if body[:1].islower() else "o"
    return f"{kind}{_DIGITS.sub('0', mark)}{size}{case}{'.' in body}"


def _start_shape(piece: str) -> str:
    first = piece.lstrip("\"'“«„‘(「¿¡")
    opened = piece[:1] != first[:1]
    case = "0" if first[:1].isdigit() else "U" if first[:1].isupper() else "l" if first[:1].islower() else "o"
    return f"{case}{opened}"


def _prior(piece: str, kind: str) -> float:
    """Before anything is counted: how likely a boundary is by the mark alone."""
    m = _ENDED.search(piece)
    if not m:
        return {"w": 0.05, "z": 0.3, "u": 0.02}.get(kind, 0.6)
    mark, closed = m[0].rstrip(_CLOSERS), m[0][-1] in _CLOSERS
    if mark[-1] in "。！？।॥؟۔｡":
        return 0.5 if closed else 0.95
    if mark[-1] == "…" or mark.endswith(".."):
        return 0.4
    return 0.5 if closed else 0.85 if mark[-1] in "?!" else 0.7


def _slot(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass")) & (SLOTS - 1)


#: What the table holds of a gap, as 32-bit numbers: slots of the shape, the piece and the pair before it, of the shape, the piece and
#: the pair behind it, and of the pair across; end of the piece before, start of the piece behind, prior in millionths, flags.
_COLUMNS = 11
_KNOWN, _COUPLED, _SMALL = 1, 2, 4


@lru_cache(1 << 17)
def _before(kind: str, piece: str, left: str) -> tuple[int, int, str, int]:
    """Of a piece before a gap: slots of its shape and of itself, itself with digits alike, its prior in millionths."""
    left = _normal(left)
    return _slot("s", _shape(piece, kind)), _slot("l", kind, left), left, int(1e6 * _prior(piece, kind))


@lru_cache(1 << 17)
def _behind(start: str, right: str) -> tuple[int, int, str, int]:
    """Of a piece behind a gap: slots of its shape and of itself, itself with digits alike, whether it begins with a small letter."""
    shape, right = _start_shape(start), _normal(right)
    return _slot("t", shape), _slot("r", right), right, _SMALL * (shape[0] == "l")


def _layout(text: str) -> tuple[list[tuple[int, int]], dict[int, tuple[int, bool]], list[int]]:
    """(the pieces; by number of the piece behind a line break: (1 if it ends a unit, else -1; is the line wrapped); numbers of the first pieces of blocks)."""
    pieces: list[tuple[int, int]] = []
    breaks: dict[int, tuple[int, bool]] = {}
    blocks: list[int] = []
    lines = [(m.start(), m[0].rstrip("\r\n")) for m in _LINE.finditer(text) if m.end() > m.start()]
    previous, blank, alone = "", True, False
    widths: list[int] = []  # of the block of lines that each line stands in
    k = 0
    while k < len(lines):
        j = k
        while j < len(lines) and lines[j][1].strip():
            j += 1
        widths += [max((len(x[1].rstrip()) for x in lines[k:j]), default=0)] * (j - k)
        if j < len(lines):
            widths.append(0)
        k = j + 1
    for (start, line), width in zip(lines, widths):
        if not line.strip():
            blank, previous, alone = True, "", False
            continue
        first = len(pieces)
        pieces += [m.span() for m in _PIECE.finditer(text, start, start + len(line))]
        head = bool(_HEAD.match(line) or _MARKUP.match(line))
        if blank or head or alone:
            blocks.append(first)
        if first and first < len(pieces):
            if blank or head or alone:
                breaks[first] = (1, False)
            else:
                before = previous.rstrip()
                word = line.split(None, 1)[0]
                step = 1 if _WIDE.search(word) else len(word) + 1
                # full enough for a wrapped line, or followed by what hardly begins a unit
                wrapped = width <= WRAPPED and len(before) + step > FULL * width or word[0].islower() or (word[0].isdigit() and len(before) >= LONG_LINE)
                marked = bool(_MARKER.match(line)) and (not wrapped or bool(_ENDED.search(before)) or bool(_MARKER.match(previous)))
                breaks[first] = (1 if marked else -1, wrapped)
        blank, previous, alone = False, line, head
    return pieces, breaks, blocks


def cut(text: str) -> tuple[int, int, list[int]]:
    """(start of the first piece, end of the last one, or -1; the numbers of all gaps that may be boundaries, _COLUMNS each)."""
    pieces, breaks, blocks = _layout(text)
    count = len(pieces)
    if not count:
        return -1, -1, []
    thai, wide = bool(_THAI.search(text)), bool(_WIDE.search(text))
    marked = [n for n in range(1, count) if text[pieces[n - 1][1] - 1] in _LAST_OF_MARK]
    numbers = set(marked).union(breaks)
    if thai:
        numbers.update(n for n in range(1, count) if "฀" <= text[pieces[n - 1][1] - 1] <= "๿" or "฀" <= text[pieces[n][0]] <= "๿")
    if wide:
        numbers.update(n for n in range(1, count) if pieces[n][0] > pieces[n - 1][1] and _WIDE.match(text[pieces[n - 1][1] - 1]) and _WIDE.match(text[pieces[n][0]]))
    unmarked: set[int] = set()
    for low, high in zip(blocks, [*blocks[1:], count]):
        if high - low >= UNMARKED and not thai and _bare(text, pieces, low, high, marked):
            begun = low + 1 + bool(_MARKER.match(text, pieces[low][0]))
            unmarked.update(n for n in range(begun, high) if not text[pieces[n][0]].islower())
    numbers |= unmarked
    spans: list[tuple[int, int]] = []
    if _PAIR_MARK.search(text):
        low = 0
        for number in sorted([*(k for k, (event, _) in breaks.items() if event == 1), count]):
            if number > low:
                spans += _inside(text, pieces[low][0], pieces[number - 1][1])
            low = number
    out: list[int] = []
    s, before = 0, -1
    for number in sorted(numbers):
        (a, b), (c, d) = pieces[number - 1], pieces[number]
        event, wrapped = breaks.get(number, (-2, False))
        piece, after = text[a:b], text[c:d]
        ended = bool(_ENDED.search(piece))
        kind = ""
        if event != 1:
            while s < len(spans) and spans[s][1] < b:
                s += 1
            if s < len(spans) and spans[s][0] < b <= spans[s][1]:
                continue
            if thai and c > b and (_THAI.match(text[b - 1]) or _THAI.match(after[0])):
                if text[b - 1].isdigit() or after[0].isdigit() or not (_THAI.match(text[b - 1]) or ended):
                    continue
                event = 1
            elif event == -2:
                if not ended:
                    # an unmarked gap: between wide letters, or in a block without any mark
                    if number in unmarked:
                        kind = "u"
                    elif wide and c > b and _WIDE.match(text[b - 1]) and _WIDE.match(after[0]):
                        kind = "z"
                    else:
                        continue
                elif (number - 1 in breaks or number == 1) and len(piece) <= 4 and _MARKER.match(text, a):
                    continue
        # behind an end mark it does not matter whether the line breaks
        kind = kind or ("" if event == -2 or ended else "w" if wrapped else "n")
        wide_end = bool(_WIDE_END.search(piece))
        if wide_end or (kind and _WIDE.match(text[b - 1])):
            left, left2, right, right2 = piece[-3:], piece[-6:-3], after[:2], after[2:4]
        else:
            left, left2 = piece, text[slice(*pieces[number - 2])] if number > 1 else "^"
            right, right2 = after, text[slice(*pieces[number + 1])] if number + 1 < count else "$"
        coupled = before == number - 1 and event == -2 and number - 1 not in breaks and not wide_end
        shape, own, left, prior = _before(kind, piece if len(piece) <= 40 else piece[-8:], left)
        start_shape, behind, right, small = _behind(after[:12], right)
        flags = _KNOWN * (event == 1) | _COUPLED * coupled | small
        out += (shape, own, _slot("ll", kind, _normal(left2), left), start_shape, behind, _slot("rr", right, _normal(right2)), _slot("x", kind, left, right))
        out += (b, c, prior, flags)
        before = number
    return pieces[0][0], pieces[-1][1], out


def _bare(text: str, pieces: list[tuple[int, int]], low: int, high: int, marked: list[int]) -> bool:
    """Whether no piece of the block ends with an end mark."""
    inside = marked[bisect_left(marked, low + 1) : bisect_left(marked, high)]
    return not any(_ENDED.search(text[slice(*pieces[n - 1])]) for n in [*inside, high])


class Model:
    """Per slot: how many gaps, and how many boundaries among them (known ones in pass 0, expected ones then)."""

    def __init__(self, n: np.ndarray, b: np.ndarray, known: bool = False):
        self.n, self.b, self.known = n, b, known
        self.base = min(max(float(b[_ALL]) / max(float(n[_ALL]), 1.0), 0.05), 0.95)

    def rate(self, slot: np.ndarray, weight: float, coarser) -> np.ndarray:
        return (self.b[slot] + weight * coarser) / (self.n[slot] + weight)

    def evidence(self, slot: np.ndarray) -> np.ndarray:
        """Does layout show boundaries here as often as where sentences end, or as seldom as by chance: a log ratio.

        What can end a sentence need not do so, so evidence for it counts little; what never does decides.
        """
        n, k = self.n[slot].astype(float), self.b[slot].astype(float)
        often = np.clip(k / np.maximum(n, 1), OFTEN, 0.9)
        return np.clip(k * np.log(often / SELDOM) + (n - k) * np.log((1 - often) / (1 - SELDOM)), -6.0, 1.0)

    def odds(self, gaps: np.ndarray) -> np.ndarray:
        """The odds that a boundary stands at each gap, by its own pieces."""
        s, l, ll, t, r, rr, x = gaps[:, :7].T
        if self.known:
            prior = gaps[:, 9] / 1e6
            rare = np.maximum(0.0, 1 - self.n[l] / FEW)
            small = np.where(gaps[:, 10] & _SMALL, -2.0, 0.0)
            moved = np.exp(self.evidence(l) + rare * np.minimum(0.0, self.evidence(s)) + self.evidence(r) + small)
            return prior / (1 - prior) * np.where(prior >= SURE, 1.0, moved)
        left = self.rate(ll, PIECE_WEIGHT, self.rate(l, SHAPE_WEIGHT, self.rate(s, 2.0, self.base)))
        right = self.rate(rr, PIECE_WEIGHT, self.rate(r, SHAPE_WEIGHT, self.rate(t, 2.0, self.base)))
        left, right = np.clip(left, 1e-4, 1 - 1e-4), np.clip(right, 1e-4, 1 - 1e-4)
        odds = left / (1 - left) * right / (1 - right) / (self.base / (1 - self.base))
        p = self.rate(x, ACROSS_WEIGHT, odds / (1 + odds))
        return np.clip(p / np.maximum(1 - p, 1e-6), 1e-6, 1e6)

    def posteriors(self, gaps: np.ndarray) -> np.ndarray:
        """Forward-backward over the events of the texts. Gaps without a single piece between them do not depend on each other, so
        only runs of coupled ones are walked through."""
        odds, flags = self.odds(gaps), gaps[:, 10]
        known = (flags & _KNOWN) > 0
        out = np.where(known, 1.0, odds / (1 + odds))
        coupled = (flags & _COUPLED) > 0
        begins = np.flatnonzero(~coupled & np.append(coupled[1:], False))
        ends = np.flatnonzero(coupled & ~np.append(coupled[1:], False))
        for low, high in zip(begins, ends + 1):
            out[low:high] = _run([None if k else o for k, o in zip(known[low:high], odds[low:high].tolist())])
        return out


def _run(odds: list[float | None]) -> list[float]:
    """Forward-backward over a run: two boundaries around a single piece are rare."""
    up, forward = [], (1.0, 0.0)
    for k, o in enumerate(odds):
        close = ONE_PIECE if k else 1.0
        none, event = forward
        now = (0.0, none + event) if o is None else (none + event, (none + event * close) * o)
        z = now[0] + now[1]
        forward = (now[0] / z, now[1] / z)
        up.append(forward)
    out, back = [0.0] * len(odds), (1.0, 1.0)
    for k in range(len(odds) - 1, -1, -1):
        p0, p1 = up[k][0] * back[0], up[k][1] * back[1]
        out[k] = p1 / (p0 + p1)
        close = ONE_PIECE if k else 1.0
        if odds[k] is None:
            back = (1.0, 1.0)
        else:
            none, event = back[0], back[1] * odds[k]
            back = (none + event, none + event * close)
            z = back[0] + back[1]
            back = (back[0] / z, back[1] / z)
    return out


_ALL = _slot("all")


def gap_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first, last, gaps): every text that is not blank, cut once and written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            made = [(key, *cut(text)) for key, text in zip(ids, texts)]
            made = [(key, first, last, np.array(gaps, np.int32).tobytes()) for key, first, last, gaps in made if first >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["id", "first", "last", "gaps"])

    some = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return materialize(some.mapInArrow(work, "id long, first int, last int, gaps binary"), "gaps")


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all gaps of a column, the number of each row's)."""
    values = blobs.to_pylist()
    return np.frombuffer(b"".join(values), np.int32).reshape(-1, _COLUMNS), np.array([len(v) // (4 * _COLUMNS) for v in values], np.int64)


def _count(table: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all texts: gaps by slot, and boundaries by slot (known, or expected under the shared model)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, b = np.zeros(SLOTS), np.zeros(SLOTS)
        for batch in batches:
            gaps, _ = _flat(batch.column(0))
            found = (gaps[:, 10] & _KNOWN).astype(float) if shared is None else shared.value.posteriors(gaps)
            for k in range(7):
                n += np.bincount(gaps[:, k], minlength=SLOTS)
                b += np.bincount(gaps[:, k], weights=found, minlength=SLOTS)
            n[_ALL] += len(gaps)
            b[_ALL] += found.sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(b[some])], names=["slot", "n", "b"])

    rows = table.select("gaps").mapInArrow(count, "slot int, n double, b double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).toPandas()
    n, b = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    n[rows["slot"].to_numpy()], b[rows["slot"].to_numpy()] = rows["n"].to_numpy(), rows["b"].to_numpy()
    return n, b


def fit(table: DataFrame) -> Model:
    """The training passes over the gaps of all texts."""
    context = table.sparkSession.sparkContext
    model = Model(*_count(table, None), known=True)
    for _ in range(ROUNDS):
        model = Model(*_count(table, context.broadcast(model)))
    return model


def sentence_table(df: DataFrame, id_col: str, text_col: str, model: Model | None = None) -> DataFrame:
    """(id, sent_start, sent_end) of each sentence of each text."""
    table = gap_table(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model or fit(table))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, last = (batch.column(k).to_numpy() for k in range(3))
            gaps, counts = _flat(batch.column(3))
            ended = shared.value.posteriors(gaps) > 0.5
            owner = np.repeat(np.arange(len(ids)), counts)[ended]
            sizes = np.bincount(owner, minlength=len(ids)) + 1
            at = np.cumsum(sizes)
            starts, ends = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum(), np.int64)
            begins, closes = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
            begins[at - sizes], closes[at - 1] = True, True
            starts[begins], starts[~begins] = first, gaps[ended, 8]
            ends[closes], ends[~closes] = last, gaps[ended, 7]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(starts), pa.array(ends)], names=["id", "sent_start", "sent_end"])

    return table.mapInArrow(decide, "id long, sent_start long, sent_end long")
