"""One consistent form for text that looks alike but differs in its characters.

First characters are normalised one by one: compatibility forms of letters, digits and spaces (full-width, half-width,
mathematical, ligatures, special spaces) become the ordinary ones, ignorable characters go, marks are composed with their
letters where one character exists for both. Then every word that mixes scripts, or stands alone in another script than
its neighbours and could be written in theirs, becomes a lattice of look-alike letters. Viterbi search takes the path of
highest score under a character trigram model, with a cost for each replaced letter and for each change of script. There is a lattice for
each script that the word could be written in, so that a word comes out in one script.

Kept as they are: superscripts and subscripts, Greek letters used as symbols, quotation marks, dashes and the
punctuation of a text's own script, joiners between letters of scripts that spell with them, direction marks beside
right-to-left letters, marks on letters for which no single character exists.

Null stays null and empty stays empty; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

from lexmill.llm.charmodel import POINTS, SMOOTHING, CharModel

REPLACE_COST, SWITCH_COST, CONTEXT_GAIN = 2.5, 4.0, 1.5

# Letters of other scripts (and phonetic letters) that look like the Latin letter before the colon.
LOOKALIKES = """
a:аɑ c:сϲ d:ԁ e:еҽ g:ɡց h:һհ i:іι j:јϳ l:ӏ n:ո o:оοօ p:рρ q:ԛգ s:ѕ u:սυ v:ѵν w:ԝѡ x:х y:уү
A:АΑ B:ВΒ C:СϹ E:ЕΕ G:Ԍ H:НΗ I:ІΙӀ J:Ј K:КΚ L:Լ M:МΜ N:Ν O:ОΟՕ P:РΡ Q:Ԛ S:ЅՏ T:ТΤ U:Ս V:Ѵ W:Ԝ X:ХΧ Y:УΥҮ Z:Ζ
"""

# The single letters of all other scripts that the Unicode confusables (ICU 77) give a Latin letter, without Greek
# letters (symbols) and compatibility forms (their own rule). No text of ours is written in these scripts.
RARE_LOOKALIKES = """
b:ЬᏏᑲᖯ c:ꮯⲥ𐐽 d:Ꮷᑯꓒ f:ք h:Ꮒ i:ꙇᎥꭵ𑣃 l:ᛁⵏꓲ𐊊𐌉𖼨 m:𑜀 n:ռ o:ⲟ𐐬𐓪𑣈𑣗 p:ⲣ q:զ r:ᴦгꮁⲅ s:ꮪ𐑈𑣁 u:𐓶𑣘 v:ꮩ𑜆𑣀 w:աꮃ𑜊𑜎𑜏 x:ᕁᕽ y:𑣜 z:ꮓ𑣄 A:Ꭺᗅꓮ𐊠𖽀 B:Ᏼᗷꓐ𐊂𐊡𐌁 C:ᏟⲤꓚ𐊢𐌂𐐕𐔜 D:Ꭰᗞᗪꓓ
E:Ꭼⴹꓰ𐊆𑢦𑢮 F:ᖴꓝ𐊇𐊥𐔥𑢢𑣂 G:ᏀᏳꓖ H:ᎻᕼⲎꓧ𐋏 I:ᛁⲒⵏꓲ𐊊𐌉𖼨 J:Ꭻᒍꓙ K:ᏦᛕⲔꓗ𐔘 L:ᏞᒪⳐꓡ𐐛𐔦𑢣𑢲𖼖 M:ᎷᗰᛖⲘꓟ𐊰𐌑 N:Ⲛꓠ𐔓 O:Ⲟⵔꓳ𐊒𐊫𐐄𐓂𐔖𑢵 P:ᏢᑭⲢꓑ𐊕 Q:ⵕ R:ᎡᏒᖇꓣ𐒴𖼵 S:ᏕᏚꓢ𐊖𐐠𖼺 T:ᎢⲦꓔ𐊗𐊱𐌕𑢼𖼊 U:ᑌꓴ𐓎𑢸𖽂
V:Ꮩᐯⴸꓦꛟ𐔝𑢠𖼈 W:ᎳᏔꓪ X:ᚷⲬⵝꓫ𐊐𐊴𐌗𐔧 Y:ᎩᎽⲨꓬ𐊲𑢤𖽃 Z:Ꮓꓜ𑢩
"""
# The same for scripts in which whole texts are written: such a letter is foreign only among Latin letters, away from its own script.
LIVING_LOOKALIKES = """
l:וןاߊ o:סهھہەഠဝჿ v:ט y:ყ I:וןاߊ O:ଠዐ U:ሀ
"""


def _pairs(table: str) -> list[tuple[str, str]]:
    return [(c, pair[0]) for pair in table.split() for c in pair[2:]]


#: By rule: small capitals and the letters that they are the capitals of.
_SMALL_CAPITALS = {chr(p): name[-1].lower() for p in range(0x250, 0xA800) if (name := unicodedata.name(chr(p), "")).startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " "}
_RARE, _LIVING = frozenset(c for c, _ in _pairs(RARE_LOOKALIKES)).union(_SMALL_CAPITALS), frozenset(c for c, _ in _pairs(LIVING_LOOKALIKES))
_LATIN_OF = _SMALL_CAPITALS | dict(_pairs(RARE_LOOKALIKES + LOOKALIKES))
_CLASS_OF = {c: pair[0] + pair[2:] for pair in LOOKALIKES.split() for c in pair[0] + pair[2:]}
_PHONETIC = "ɑɡ"
#: Letters that a Russian writer would use: the aim of Latin letters in a Cyrillic word.
_CYRILLIC_OF = {pair[0]: c for pair in LOOKALIKES.split() for c in pair[2:] if "А" <= c <= "я"}
_CYRILLIC_OF |= {c: _CYRILLIC_OF[a] for c, a in _pairs(RARE_LOOKALIKES) if a in _CYRILLIC_OF}
# rare letters are left for Latin ones, or Cyrillic ones beside Cyrillic, never put in their place
for _c, _a in [*_pairs(RARE_LOOKALIKES + LIVING_LOOKALIKES), *_SMALL_CAPITALS.items()]:
    _CLASS_OF[_c] = _CLASS_OF.get(_c, _c) + _a


def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)


_IGNORED = _ranges((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F), (0xAD, 0xAD), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
_JOINING = re.compile("[" + _ranges((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x0F00, 0x109F), (0x1780, 0x18AF)) + "]")
_RTL = re.compile("[" + _ranges((0x0590, 0x08FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFE)) + "]")
_DIRECTION = set(map(chr, [0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]))


@lru_cache(1)
def compatibility() -> dict[int, str]:
    """By rule over all of Unicode: letters, digits and spaces that stand for ordinary ones."""
    table = {}
    for point in range(0x80, POINTS):
        c = chr(point)
        kind, way = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Zs":
            table[point] = " "
        elif way.startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")):
            to = unicodedata.normalize("NFKC", c)
            radical = 0x2E80 <= point <= 0x2FDF
            greek_symbol = way.startswith("<compat>") and any(0x370 <= ord(x) <= 0x3FF for x in to)
            if (kind[0] == "L" or kind in ("Nd", "Nl") or radical or (to.isalnum() and to.isascii() and kind != "No")) and not greek_symbol and to != c:
                table[point] = to
    return table


@lru_cache(1)
def _odd() -> re.Pattern:
    """Characters that alone make a value worth a closer look."""
    marks = _ranges((0x300, 0x36F), (0x3099, 0x309A))
    singles = "".join(re.escape(chr(p)) for p in compatibility() if p < 0x10000)
    singletons = "".join(chr(p) for p in range(0x80, 0x3000) if (n := unicodedata.normalize("NFC", chr(p))) != chr(p) and len(n) == 1)
    # Characters beyond 16 bits stay out of the class, which is then a table and fast; any of them is worth the look.
    ignored = re.sub("[\U00010000-\U0010ffff]-?", "", _IGNORED)
    return re.compile(f"[{ignored}{marks}{singles}{singletons}]|[\U00010000-\U0010ffff]")


_IGNORED_RUN = re.compile(f"[{_IGNORED}]+")
_NON_LATIN = "".join(c for c in _LATIN_OF)
_WORTH = re.compile(f"[{''.join(c for c in _NON_LATIN if c < chr(0x10000))}]|[\U00010000-\U0010ffff]|[A-Za-z][{''.join(sorted(_LIVING))}]|[{''.join(sorted(_LIVING))}][A-Za-z]")
_LETTER_RUN = re.compile(r"[^\s]+")


def _drop_ignored(text: str) -> str:
    def judged(m: re.Match) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        kept = ""
        for c in m[0]:
            if c in "‌‍":
                keep = _JOINING.match(before or " ") and _JOINING.match(after or " ")
            elif c in _DIRECTION:
                keep = _RTL.search(before + after)
            elif "︀" <= c <= "️":
                keep = before and unicodedata.category(before) == "So"
            else:
                keep = False
            kept += c if keep else ""
        return kept

    return _IGNORED_RUN.sub(judged, text)


def normalise_characters(text: str) -> str:
    """Compatibility forms, ignorable characters and composition: what needs no context."""
    if text.isascii() and not _IGNORED_RUN.search(text):
        return text
    if not _odd().search(text):
        return text
    return unicodedata.normalize("NFC", _compose(_drop_ignored(text).translate(compatibility())))


def _compose(text: str) -> str:
    # half-width voicing marks arrive as spacing ones
    return text.replace("゛", "゙").replace("゜", "゚") if re.search("[ァ-ヺ][゛゜]", text) else text


def script(c: str) -> str:
    if c in _PHONETIC:
        return "phonetic"
    if c < "ɐ":
        return "Latin" if c.isalpha() else ""
    if "Ͱ" <= c <= "Ͽ":
        return "Greek"
    if "Ѐ" <= c <= "ԯ":
        return "Cyrillic"
    if "԰" <= c <= "֏":
        return "Armenian"
    if c in _RARE:
        return "rare"
    return "other" if c.isalpha() else ""


_WRITTEN = ("Latin", "Cyrillic", "Greek", "Armenian")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-ԯ]|[Ѐ-ԯ][A-Za-zÀ-ɏ]")


def _of_one_script(scripts: list[str], i: int) -> bool:
    """Whether the run of letters around a place is of one script, which is then left as it is."""
    low = high = i
    while low and scripts[low - 1]:
        low -= 1
    while high + 1 < len(scripts) and scripts[high + 1]:
        high += 1
    return len(set(scripts[low : high + 1])) == 1 and scripts[i] in _WRITTEN


def fold_word(word: str) -> str:
    """A quick fold without a model, towards the script of most letters: only for comparison."""
    word = normalise_characters(word)
    found = [s for s in map(script, word) if s]
    if len(set(found)) < 2:
        return word
    if found.count("Cyrillic") > found.count("Latin"):
        return "".join(_CYRILLIC_OF.get(c, c) for c in word)
    return "".join(_LATIN_OF.get(c, c) for c in word)


class Consistent:
    """Brings values to the consistent form. Words that were searched are remembered."""

    def __init__(self, model: CharModel):
        self.model = model
        self.words: dict[tuple[str, str], str] = {}
        self.grams: dict[tuple[str, str, str], float] = {}

    def gram(self, a: str, b: str, c: str) -> float:
        held = self.grams.get((a, b, c))
        if held is None:
            if len(self.grams) > 500_000:
                self.grams.clear()
            x, y, z = ("0" if p.isascii() and p.isdigit() else p for p in (a, b, c))
            full = (1 << 64) - 1
            pair = (min(ord(x), POINTS - 1) * 0x9E3779B97F4A7C15 + min(ord(y), POINTS - 1) * 0xC2B2AE3D27D4EB4F) * 0xD6E8FEB86659FD93 & full
            last = min(ord(z), POINTS - 1)
            triple = (pair ^ (last * 0xA0761D6478BD642F & full)) * 0xE7037ED1A0B428DB & full
            m = self.model
            held = self.grams[a, b, c] = math.log((m.triples[triple >> 44] + SMOOTHING * m.single[last]) / (m.pairs[pair >> 46] + SMOOTHING))
        return held

    def search(self, word: str, context: str) -> str:
        """The best of the lattices for each script that the word could be written in, and of the word as it stands. A path holds one script in
        each run of letters as far as look-alikes go; a mix of Latin and Cyrillic is kept only where no path is free of one."""
        scripts = [script(c) for c in word]
        targets = {s for s in scripts if s in _WRITTEN} | ({context} if context in _WRITTEN else set()) or {"Latin"}
        found = [self._path(word, scripts, target, context) for target in sorted(targets)]
        pure = [path for path in found if not _MIXED.search(path[1])]
        if pure and _MIXED.search(word):
            found = pure
        else:
            found.append(self._path(word, scripts, "", context))
        return max(found, key=lambda x: (x[0], x[1] == word, x[1]))[1]

    def _path(self, word: str, scripts: list[str], target: str, context: str) -> tuple[float, str]:
        """Viterbi over the lattice of the word's look-alikes in one script; the state is the last two characters."""
        states: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
        for i, c in enumerate(word):
            options = c
            if target and scripts[i] not in ("", target) and not (c in _LIVING and (context == "own" or "other" in scripts[max(i - 1, 0) : i] + scripts[i + 1 : i + 2])):
                if context or not _of_one_script(scripts, i):
                    options = "".join(o for o in _CLASS_OF.get(c, "") + _CYRILLIC_OF.get(c, "") if script(o) == target) or c
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (score, path) in states.items():
                before = script(b)
                for o in dict.fromkeys(options):
                    s = script(o)
                    now = score + self.gram(a, b, o)
                    if o != c:
                        now -= REPLACE_COST
                    if s and before and s != before:
                        now -= SWITCH_COST
                    if context and s == context:
                        now += CONTEXT_GAIN
                    held = following.get((b, o))
                    if held is None or now > held[0]:
                        following[b, o] = (now, path + o)
            states = following
        return max((score + self.gram(a, b, " "), path) for (a, b), (score, path) in states.items())

    def form(self, text: str | None) -> str | None:
        if not text or (text.isascii() and not _IGNORED_RUN.search(text)):
            return text
        text = normalise_characters(text)
        if text.isascii() or not _WORTH.search(text):
            return text
        words = _LETTER_RUN.findall(text)
        scripts: dict[int, str] = {}

        def script_at(i: int) -> str:
            if i not in scripts:
                kinds = {s for s in map(script, words[i]) if s}
                kinds -= {"rare"} if kinds == {"rare", "other"} else set()  # a word of that script itself
                scripts[i] = kinds.pop() if len(kinds) == 1 else ("mixed" if kinds else "")
            return scripts[i]

        changed = {}
        # ASCII words are of no interest but beside a Cyrillic one
        wide = [i for i, word in enumerate(words) if not word.isascii()]
        for i in sorted({j for i in wide for j in (i - 1, i, i + 1) if 0 <= j < len(words)}):
            word = words[i]
            if word.isascii() and not ("Cyrillic" in (script_at(i - 1) if i else "", script_at(i + 1) if i + 1 < len(words) else "")):
                continue
            own = script_at(i)
            if own in ("", "other"):
                continue
            context = ""
            if own != "mixed":
                near = set()
                for step in (-1, 1):
                    j = i + step
                    while 0 <= j < len(words) and not script_at(j):
                        j += step
                    if 0 <= j < len(words):
                        near.add(script_at(j))
                near -= {"mixed", "rare"}
                if len(near) != 1 or own in near:
                    continue
                context = near.pop()
                letters = [c for c in word if script(c)]
                if context == "Latin" and not all(c in _LATIN_OF for c in letters) or context == "Cyrillic" and not all(c in _CYRILLIC_OF for c in letters) or context not in ("Latin", "Cyrillic"):
                    continue
            elif not any(c in _CLASS_OF for c in word):
                continue
            elif any(c in _LIVING for c in word) and "other" in (script_at(i - 1) if i else "", script_at(i + 1) if i + 1 < len(words) else ""):
                context = "own"
            key = (word, context)
            held = self.words.get(key)
            if held is None:
                if len(self.words) > 200_000:
                    self.words.clear()
                held = self.words[key] = self.search(word, context)
            if held != word:
                changed[i] = held
        if not changed:
            return text
        numbers = iter(range(len(words)))
        return _LETTER_RUN.sub(lambda m: changed.get(next(numbers), m[0]), text)
