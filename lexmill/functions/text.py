"""Column expressions over text; all but fold_key stay inside code generation.

Patterns use explicit classes: Java's and other engines' word boundaries differ beyond ASCII.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLLOWING = "\u0001"

_TAG = re.compile(r"<[^>]*>")
#: What an inline tag leaves when its brackets were taken off.
_TAG_REMNANT = re.compile(r"(?<![^\W_])/?(?:i|b|u|em|sub|sup|sc|scp)(?![^\W_])", re.IGNORECASE)
_NO_LETTER = re.compile(r"[\W_]+")


def ascii_view(c: Column) -> Column:
    """The text with every character beyond printable ASCII as a space."""
    return F.regexp_replace(c, "[^ -~]", " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def normalized_text(c: Column) -> Column:
    """P1 without compatibility forms: line ends, spaces within lines, runs of blank lines, blank ends."""
    lines = F.regexp_replace(c, "\\r\\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, "[ \\t]+", " "), " ?\\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


def tokens(c: Column) -> Column:
    """Words of ASCII letters and digits in small letters, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by rule; the final sigma counts as any other."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower()]
    pairs = [(c, plain) for c, plain in pairs if plain != c] + [("ς", "σ")]
    return "".join(c for c, _ in pairs), "".join(plain for _, plain in pairs)


MARKED, PLAIN = _plain_letters()


def words(c: Column) -> Column:
    """The words that search goes by: runs of letters and digits of all scripts, in small letters, Latin ones without marks, in order."""
    return F.regexp_extract_all(F.translate(F.lower(c), MARKED, PLAIN), F.lit("([\\p{L}\\p{N}]+)"), 1)


def folded(text: str) -> str:
    """Entities decoded, tags and their remnants gone; letters and digits of all scripts only, without accents or case."""
    text = _TAG_REMNANT.sub(" ", _TAG.sub(" ", html.unescape(text)))
    if not text.isascii():
        # the iota below is the one combining mark that casefold makes a letter of; all others go with the signs
        text = unicodedata.normalize("NFKD", text).replace("\u0345", "")
    return _NO_LETTER.sub("", text.casefold())


def fold_key(c: Column) -> Column:
    """P4 over all scripts, in Arrow batches: no built-in expression decomposes characters or decodes entities."""

    def fold(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else folded(t) for t in texts.to_pylist()], pa.string())

    fold.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(fold, "string")(c)


def sentences(c: Column) -> Column:
    """Pieces behind an end mark and blanks."""
    return F.split(F.regexp_replace(c, "([.!?])[ \\t\\r\\n]+", "$1" + FOLLOWING), FOLLOWING)


def without_intervals(c: Column) -> Column:
    """Confidence intervals are notation, no findings."""
    return F.regexp_replace(c, "(?i)[0-9]{1,2}([.][0-9]+)?[ ]?%[ ]?(CI|confidence)", " ")


def percentages(c: Column) -> Column:
    """Percentages of one or two digits before the point."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), without_intervals(c)), F.lit("[^0-9.]([0-9]{1,2}([.][0-9]+)?)[ ]?%"), 1)
    return F.transform(found, lambda x: x.cast("double"))


def sample_sizes(c: Column) -> Column:
    """What stands behind n =."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), c), F.lit("[^A-Za-z0-9_][nN][ ]?=[ ]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("long"))


def years(c: Column) -> Column:
    """The different years from 1500 to 2099, in order."""
    # a separator belongs to one match only, so every run of digits is looked at by itself
    runs = F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    return F.array_distinct(F.filter(runs, lambda x: x.rlike("^(1[5-9][0-9]{2}|20[0-9]{2})$")))


def identifier(url: Column) -> Column:
    """DOI before work number before paper number."""
    low = F.lower(F.coalesce(url, F.lit("")))
    doi = F.regexp_extract(low, "(10[.][0-9]{4,9}/[^ ?#&]+)", 1)
    work = F.regexp_extract(low, "/(w[0-9]{6,})", 1)
    paper = F.regexp_extract(low, "/pm/([0-9]{5,})", 1)
    return (
        F.when(doi != "", F.concat(F.lit("doi:"), F.regexp_replace(doi, "/+$", "")))
        .when(work != "", F.concat(F.lit("work:"), work))
        .when(paper != "", F.concat(F.lit("paper:"), paper))
    )


def junk_reason(text: Column) -> Column:
    """the first reason that holds; null for text to keep. Null text counts as too short."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    solid = F.length(F.regexp_replace(text, "[ \\t\\r\\n]", ""))
    lines = F.array_sort(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(held, line):
        run = F.when(held["line"] == line, held["run"] + 1).otherwise(1)
        return F.struct(line.alias("line"), run.alias("run"), F.greatest(held["best"], run).alias("best"))

    top = F.aggregate(lines, start, step, lambda held: held["best"])
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) < 200, "too_short")
        .when(F.length(text) > 100_000, "too_long")
        .when(letters < 0.5 * solid, "low_alpha")
        .when((F.size(lines) >= 4) & (top > 0.3 * F.size(lines)), "boilerplate")
    )


def answer_key(c: Column) -> Column:
    """P16 for ASCII: small letters, punctuation as spaces, articles gone."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[!-/:-@\\[-`{-~]", " "), "[ ]+"), lambda w: ~w.isin("", "a", "an", "the"))
    return F.array_join(words, " ")


def number(c: Column) -> Column:
    """A pure number, thousands separators and a trailing point tolerated."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "[.]+$", ""), ",", "")
    return F.when(plain.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"), plain.try_cast("double"))
