"""Tokenizing by memory: texts fall apart where no token can lie across, and each distinct part is encoded
by the tokenizer's own library and remembered by a worker.

The word vocabulary's own pattern cuts at white space, between letters, digits and signs; the piece
vocabulary has no piece across a word start, nor one with a letter before certain signs. A text's ids are
its parts' ids in a row. A memory holds a bounded number of parts in two generations: when the younger
is full it becomes the older, and what is used again moves to the younger.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers

#: Parts that a worker remembers.
REMEMBERED = 160_000
#: Words that a worker remembers the ids of.
REMEMBERED_WORDS = 360_000

# Unicode's White_Space characters.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_CUTS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")  # special tokens begin with the first
# The word vocabulary's pattern, for lower-case Latin-1 texts.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_PLAIN = re.compile(f"[{_LETTERS}]+")


class Memory(dict):
    """What ``encode_all`` gives for each part."""

    def __init__(self, encode_all: Callable[[list[str]], list], limit: int = REMEMBERED):
        super().__init__()
        self.encode_all, self.limit, self.older = encode_all, limit, {}

    def __missing__(self, part: str):
        value = self[part] = self.older[part]
        return value

    def learn(self, parts_of_texts: list[list[str]]) -> None:
        """Encode what is new in these texts."""
        new = set().union(*parts_of_texts)
        missing = [p for p in new if p not in self and p not in self.older]
        if len(self) + len(missing) > self.limit // 2:
            rest = [p for p in self.older if p in new]
            kept = {p: self.older[p] for p in rest}
            self.older = dict(self) | kept  # what these texts need stays
            self.clear()
        self.update(zip(missing, self.encode_all(missing), strict=True))


def word_parts(text: str) -> list[str]:
    """The parts of a text for the word vocabulary, which drops white space and case."""
    try:
        text.encode("latin-1")  # here case does not depend on a letter's surroundings
    except UnicodeEncodeError:
        return [p for p in _WHITE.split(text) if p]
    if any(x in text for x in _NO_CUTS):
        return [p for p in _WHITE.split(text) if p]
    return _WORDS.findall(text.lower())


def word_memory(path: str | None = None, remembered: int = REMEMBERED_WORDS) -> Memory:
    """Part to its ids as little-endian unsigned 32-bit numbers."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    library = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ends = np.zeros(library.get_vocab_size(), bool)
    ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True

    def encode_each(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in library.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_words(parts: list[str]) -> list[bytes]:
        """Of plain words: many in one call, which end where a word end stands."""
        out = []
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            ids = np.array(library.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = 4 * (np.flatnonzero(ends[ids]) + 1)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if len(cuts) == len(some) else encode_each(some)
        return out

    def encode_all(parts: list[str]) -> list[bytes]:
        plain, rest = [], []
        for p in parts:
            (plain if _PLAIN.fullmatch(p) else rest).append(p)
        found = dict(zip(plain, encode_words(plain), strict=True)) | dict(zip(rest, encode_each(rest), strict=True))
        return [found[p] for p in parts]

    return Memory(encode_all, remembered)


# No piece has one of these signs after a letter (piece_library makes sure).
_SIGNS = ".,;:!?|()\"'-"
_PIECE_PARTS = re.compile(f"\u2581*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[{re.escape(_SIGNS)}\u2581]|\\Z)|\u2581*[^\u2581]+|\u2581+")


def piece_parts(text: str) -> list[str]:
    """The parts of a text for the piece vocabulary, with their word starts: a run of word starts and what
    follows it, cut between letters and signs."""
    return _PIECE_PARTS.findall("\u2581" + text.replace(" ", "\u2581")) if text else []


def piece_library(path: str | None = None):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    crossing = re.compile(f"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][{re.escape(_SIGNS)}]|[^\u2581]\u2581")
    if wrong := [p for i in range(library.get_piece_size()) if crossing.search(p := library.id_to_piece(i))]:
        raise ValueError(f"this vocabulary has pieces across the cuts: {wrong[:5]}")
    return library


def piece_count_memory(path: str | None = None) -> Memory:
    """Part to its number of ids."""
    library = piece_library(path)

    def encode_all(parts: list[str]) -> list[int]:
        # The library adds a word start of its own; a part without one is put behind a sign that joins nothing.
        asked = [p[1:] if p[0] == "\u2581" and p != "\u2581" else "\n" + p for p in parts]
        counts = [len(ids) for ids in library.encode(asked, num_threads=1)]
        lone = len(library.encode("\n"))
        return [1 if p == "\u2581" else n if p[0] == "\u2581" else n - lone for p, n in zip(parts, counts, strict=True)]

    return Memory(encode_all)
