"""Token and declaration functions over columns; all in the JVM but full Unicode normalisation."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.dims import FIELD_NAMES, MODIFIERS, NOISE

_CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ"
#: Places between which a token ends: case changes, the last capital of an acronym, letters and digits, Latin and CJK.
BOUNDARIES = (
    r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"
    rf"|(?<=[{_CJK}])(?=[\p{{L}}&&[^{_CJK}]])|(?<=[\p{{L}}&&[^{_CJK}]])(?=[{_CJK}])"
)


# Full-width signs, letters and digits and the wide blank, and what they stand for.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def narrow(text: Column) -> Column:
    """Full-width forms as the plain ones: the compatibility forms that labels are written in."""
    return F.translate(text, _WIDE, _NARROW)


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text, full-width forms as plain ones (other compatibility forms stay); null gives none."""
    parts = F.split(F.regexp_replace(narrow(F.coalesce(text, F.lit(""))), BOUNDARIES, " "), r"[^\p{L}\p{N}\p{M}]+")
    return F.transform(F.filter(parts, lambda t: t != ""), F.lower)


def identifier_tokens(text: Column) -> Column:
    """Tokens of an identifier without what frameworks add, before and after the split; repeats stay."""
    fragments = F.filter(F.split(narrow(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda t: (t != "") & ~F.lower(t).isin(*NOISE))
    return F.filter(tokens(F.array_join(fragments, " ")), lambda t: ~t.isin(*NOISE))


def joined(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


class _Kinds(dict):
    """A sign for what a character is, by code point: made when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        held = (c.islower(), c.isupper(), c.isalpha(), c.isdigit(), bool(_IS_CJK.match(c)), c.isalnum() or unicodedata.category(c)[0] == "M")
        self[point] = sign = chr(_FIRST_SIGN + sum(h << k for k, h in enumerate(held)))
        return sign


_IS_CJK, _FIRST_SIGN, _KINDS = re.compile(f"[{_CJK}]"), 0x30, _Kinds()


def _run_pattern() -> re.Pattern:
    """A token in the signs of a text: signs of words without a place between them where a token ends."""
    of = lambda held: "[" + "".join(re.escape(chr(_FIRST_SIGN + k)) for k in range(64) if held(*(bool(k >> b & 1) for b in range(6)))) + "]"
    lower, upper, letter, digit = (of(lambda *x, b=b: x[b]) for b in range(4))
    cjk, other, word = of(lambda *x: x[2] and x[4]), of(lambda *x: x[2] and not x[4]), of(lambda *x: x[5])
    edges = ((lower, upper), (upper, upper + lower), (letter, digit), (digit, letter), (cjk, other), (other, cjk))
    return re.compile(f"{word}(?:(?!{'|'.join(f'(?<={p}){n}' for p, n in edges)}){word})*")


_RUN = _run_pattern()


def _cut(text: str) -> list[str]:
    return [text[m.start() : m.end()] for m in _RUN.finditer(text.translate(_KINDS))]


def _folded(text: str) -> tuple[str, ...]:
    """The tokens of a normalised text, cut again where folding makes a new place to cut."""
    return tuple(t for first in _cut(text) for t in _cut(unicodedata.normalize("NFKC", first.casefold())))


_remembered = functools.lru_cache(100_000)(_folded)  # words repeat; blanks part tokens and what decides on their ends


def _python_tokens(raw: str | None) -> list[str]:
    return [t for word in unicodedata.normalize("NFKC", raw or "").split() for t in (_remembered(word) if len(word) <= 40 else _folded(word))]


def unicode_tokens(text: Column) -> Column:
    """Tokens after NFKC and case folding; Arrow batches in Python, as Spark has no Unicode normaliser."""

    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(_python_tokens)

    return F.pandas_udf(normalise, "array<string>")(text)


def declaration(raw: Column) -> Column:
    """The parts of an autocomplete attribute: token, modifiers, section, is_off, is_off_spec. A null attribute is on spec."""
    words = F.filter(F.split(F.lower(raw), r"\s+"), lambda t: t != "")
    section = F.filter(words, lambda t: t.startswith("section-"))
    rest = F.filter(words, lambda t: ~t.startswith("section-") & ~t.isin(*MODIFIERS, "off", "on"))
    switch = F.exists(words, lambda t: t.isin("off", "on"))
    off_spec = F.when(switch, F.size(rest) > 0).otherwise((F.size(rest) != 1) | ~F.coalesce(F.get(rest, F.lit(0)).isin(*FIELD_NAMES), F.lit(False)))
    return F.struct(
        F.get(rest, F.lit(0)).alias("token"),
        F.coalesce(F.filter(words, lambda t: t.isin(*MODIFIERS)), F.array().cast("array<string>")).alias("modifiers"),
        F.get(section, F.lit(0)).alias("section"),
        F.coalesce(F.array_contains(words, "off"), F.lit(False)).alias("is_off"),
        F.when(raw.isNotNull(), F.coalesce(off_spec, F.lit(False))).otherwise(False).alias("is_off_spec"),
    )


def label_source(*names: str) -> Column:
    """The first of the named columns that is not null; a blank text counts."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.col(name).isNotNull(), F.lit(name)).otherwise(out)
    return out


# Patterns of identifiers that say nothing.
_GENERIC = (r"^input\d+$", r"^field[_-]?\d+$", r"^txt\d+$", r"^ctl\d+", r"ctl\d+\$", r"^[0-9a-f]{8,}$")
GENERIC = "|".join(_GENERIC)


def is_generic(identifier: Column) -> Column:
    return F.coalesce(F.lower(identifier).rlike(GENERIC), F.lit(False))


def looks_generated(identifier: Column) -> Column:
    """A run of four digits, or eight hexadecimal digits between delimiters."""
    return F.coalesce(identifier.rlike(r"\d{4}|(?<![0-9A-Za-z])[0-9a-f]{8,}(?![0-9A-Za-z])"), F.lit(False))


def char_ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams within blank-padded words; a word shorter than n appears once, whole."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        of = lambda n: F.when(F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda k: F.substring(w, k, F.lit(n))))
        return F.flatten(F.array_compact(F.array(*(of(n) for n in range(least, most + 1)))))

    return F.flatten(F.transform(words, grams))


def word_ngrams(text: Column) -> Column:
    """Words and pairs of neighbours."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """The name of the range between two bounds that a whole number lies in: '0', '1to2', ... '65plus'; null stays null."""
    name = F.lit(f"{bounds[-1]}plus")
    for below, bound in reversed(list(zip((0, *bounds), bounds))):
        name = F.when(value < bound, str(below) if bound - 1 <= below else f"{below}to{bound - 1}").otherwise(name)
    return F.when(value.isNotNull(), name)
