"""Cross-tokenizer alignment: which tokens of two vocabularies lie over the same bytes.

Both tokenizers' tokens end at byte offsets. Where both end, the text is cut into groups; the common
ends are found by galloping intersection: the shorter list of ends drives an exponential and then a
binary search into the longer one. Ranks of common ends slice the token lists into groups, and the
differences of ranks are the ranges of tokens that overlap.

A text falls into parts (white space and what follows it, cut between letters and signs) across which no
token of either vocabulary lies; each distinct part is encoded, aligned and remembered once by a worker.

Links (pairs of an A and a B token in one group) are counted over the corpus without moving them:
a task gathers the distinct pairs of some thousand documents (a chunk, bounded by its entries) in a
dictionary, documents point into it, and only dictionaries are shuffled: added up by pair, joined
back, and brought to their chunk's documents. Within a group pairs are products of distinct ids.

Defined results: a null or empty text, or one that either vocabulary does not give back byte by byte
(U+2581 in it), has no tokens: zeros and an empty groups_sha256; repeated rows and repeated or null
ids each keep their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, stored, table

#: Distinct (document, pair) entries of a chunk, at most (a single document may have more).
CHUNK_ENTRIES = 2_000_000
#: Parts and their pairs that a worker remembers; it forgets all beyond.
REMEMBERED, REMEMBERED_PAIRS = 400_000, 4_000_000
#: Links of a group that are listed one by one; a longer group's are products of distinct ids at once.
MOST_IN_ONE = 4096

# Unicode's White_Space characters but for the carriage return, and signs that no piece has after a letter.
_WHITE = "\t-\x0c \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_SIGNS = ".,;:!?|()\"'-"
# White space and a word, white space and any run (a carriage return may be joined to what precedes it: no cut there), the white space at the end.
_PARTS = re.compile(
    f"[{_WHITE}\r]*[{_LETTERS}]++(?=[{re.escape(_SIGNS)}{_WHITE}]|\\Z)|[{_WHITE}\r]*[^{_WHITE}\r]+(?:\r[{_WHITE}\r]*[^{_WHITE}\r]+)*(?:\r[{_WHITE}\r]*\\Z)?|[{_WHITE}\r]+"
)


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks (i, j) with a[i] == b[j] of two strictly ascending lists, by galloping intersection."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    found, at, n = [], 0, len(b)
    for i, x in enumerate(a):
        step, low = 1, at
        while at + step < n and b[at + step] < x:  # exponential
            low, step = at + step, 2 * step
        at = bisect_left(b, x, low, min(n, at + step + 1))  # binary
        if at == n:
            break
        if b[at] == x:
            found.append((i, at))
            at += 1
    return found


def overlaps(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """i0, i1, j0, j1: per group the A tokens [i0, i1) and the B tokens [j0, j1) that lie over the same bytes."""
    ranks = np.array(common_ends(a_ends, b_ends), np.int64).reshape(-1, 2) + 1
    starts = np.concatenate([np.zeros((min(1, len(ranks)), 2), np.int64), ranks[:-1]])
    return starts[:, 0], ranks[:, 0], starts[:, 1], ranks[:, 1]


class Tokenizers:
    """The two libraries and the bytes of their tokens."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.a = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        special = set(self.a.get_added_tokens_decoder())
        self.a_bytes = {i: token.encode() if i in special else bytes(letter[c] for c in token) for token, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in of]) for of in ([self.a_bytes[i] for i in range(len(self.a_bytes))], self.b_bytes))
        self.n_b = len(pieces)
        self.lone = len(self.b.encode("\n"))
        self.make_sure(pieces)

    def make_sure(self, pieces: list[str]) -> None:
        """That no piece lies across the cuts between parts."""
        crossing = re.compile(f"[{_LETTERS}][{re.escape(_SIGNS)}]|[^▁]▁|.[{_WHITE}]", re.DOTALL)
        if wrong := [p for p in pieces if crossing.search(p)]:
            raise ValueError(f"this vocabulary has pieces across the cuts: {wrong[:5]}")

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        """Of some parts in one call where white space stands between them, which no token lies across."""
        out = []
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            if all(p[0] == " " and not p[-1].isspace() for p in some):
                ids = self.a.encode("".join(some), add_special_tokens=False).ids
                ends = np.cumsum(self.a_lengths[ids])
                cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in some])) + 1
                out += [ids[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            else:
                out += [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of parts, which begin with a blank only where a word starts."""
        first = sorted(range(len(parts)), key=lambda k: parts[k][0] != " " or parts[k][-1].isspace())
        a = [None] * len(parts)
        for k, ids in zip(first, self.encode_a([parts[k] for k in first]), strict=True):
            a[k] = ids
        # The other library adds a word start of its own; a part without one is put behind a sign that joins nothing.
        asked = [p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in parts]
        b = [ids if p[0] == " " and len(p) > 1 else ids[self.lone :] for p, ids in zip(parts, self.b.encode(asked, num_threads=1), strict=True)]
        return a, b


def intact(library: Tokenizers, part: str, a: list[int], b: list[int]) -> bool:
    """Do both vocabularies give the part's bytes back?"""
    return b"".join(map(library.a_bytes.__getitem__, a)) == part.encode() == b"".join(map(library.b_bytes.__getitem__, b))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts and numbers (none is negative) in 32 bits if all of them fit."""
    return values.astype(np.int64 if len(values) and values.max() > np.iinfo(np.int32).max else np.int32)


class _Growing:
    """An array that grows at its end, of 32-bit numbers as long as all of them fit."""

    def __init__(self):
        self.values, self.n = np.empty(1024, np.int32), 0

    def extend(self, more) -> None:
        more = _narrow(np.asarray(more))
        kind, end = np.promote_types(self.values.dtype, more.dtype), self.n + len(more)
        if end > len(self.values) or kind != self.values.dtype:
            values = np.empty(max(len(self.values), end + end // 4), kind)
            values[: self.n] = self.values[: self.n]
            self.values = values
        self.values[self.n : end] = more
        self.n = end


class _Index(dict):
    """Parts by number; new ones are numbered as they are met."""

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        return number


class Parts:
    """What a worker remembers of parts: their groups as text, their numbers, their distinct pairs."""

    COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "intact", "first", "pairs")

    def __init__(self, library: Tokenizers):
        self.library, self.room = library, len(library.a_bytes) * library.n_b
        self.a_text, self.b_text = list(map(str, range(len(library.a_bytes)))), list(map(str, range(library.n_b)))
        self.forget()

    def forget(self) -> None:
        self.index, self.texts = _Index(), []
        self.of = {c: _Growing() for c in self.COLUMNS}
        self.keys, self.weights = _Growing(), _Growing()

    def __getitem__(self, column: str) -> np.ndarray:
        return self.of[column].values

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The parts of texts as numbers; what is new is learned."""
        if len(self.index) > REMEMBERED or self.keys.n > REMEMBERED_PAIRS:
            self.forget()
        known, get = len(self.index), self.index.__getitem__
        found = [list(map(get, parts)) for parts in texts]
        self.learn(list(islice(self.index, known, None)))
        return found

    def learn(self, parts: list[str]) -> None:
        """Encode and align new parts, all in a row as if they were one text."""
        if not parts:
            return
        a_ids, b_ids = self.library.encode(parts)
        whole = [intact(self.library, p, a, b) for p, a, b in zip(parts, a_ids, b_ids, strict=True)]
        none: list[int] = []
        a_ids, b_ids = ([x if ok else none for x, ok in zip(ids, whole, strict=True)] for ids in (a_ids, b_ids))
        n, n_a, n_b = len(parts), np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        i0, i1, j0, j1 = overlaps(np.cumsum(self.library.a_lengths[a]).tolist(), np.cumsum(self.library.b_lengths[b]).tolist())
        part = np.repeat(np.arange(n), n_a)[i0]
        links = (i1 - i0) * (j1 - j0)
        n_groups = np.bincount(part, minlength=n)
        self.remember_texts(a, b, i0, i1, j0, j1, n_groups)

        few = links <= MOST_IN_ONE
        size, of = links[few], np.flatnonzero(few)
        group = np.repeat(of, size)
        rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = (j1 - j0)[group]
        keys = part[group] * self.room + a[i0[group] + rank // width] * self.library.n_b + b[j0[group] + rank % width]
        keys, weights = np.unique(keys, return_counts=True)
        for g in np.flatnonzero(~few):  # long groups: products of distinct ids
            (x, m), (y, k) = np.unique(a[i0[g] : i1[g]], return_counts=True), np.unique(b[j0[g] : j1[g]], return_counts=True)
            keys = np.concatenate([keys, (part[g] * self.room + x[:, None] * self.library.n_b + y).ravel()])
            weights = np.concatenate([weights, (m[:, None] * k).ravel()])
        if not few.all():
            keys, where = np.unique(keys, return_inverse=True)
            weights = np.bincount(where, weights, len(keys)).astype(np.int64)
        pairs = np.bincount(keys // self.room, minlength=n)
        columns = (n_a, n_b, n_groups, np.bincount(part, links, n), whole, self.keys.n + np.cumsum(pairs) - pairs, pairs)
        for c, values in zip(self.COLUMNS, columns, strict=True):
            self.of[c].extend(values)
        self.keys.extend(keys % self.room)
        self.weights.extend(weights)

    def remember_texts(self, a, b, i0, i1, j0, j1, n_groups) -> None:
        a_text, b_text = list(map(self.a_text.__getitem__, a.tolist())), list(map(self.b_text.__getitem__, b.tolist()))
        groups = [f"{','.join(a_text[p:q])}|{','.join(b_text[r:s])}" for p, q, r, s in zip(i0.tolist(), i1.tolist(), j0.tolist(), j1.tolist(), strict=True)]
        ends = np.cumsum(n_groups).tolist()
        self.texts += [";".join(groups[p:q]).encode() for p, q in zip([0, *ends[:-1]], ends, strict=True)]


def text_parts(text: str | None) -> list[str]:
    return _PARTS.findall(" " + text) if text else []


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINKED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, slot int, a int, b int, docs int"


def _batch(doc_texts: list[str | None], parts: Parts) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' own columns, and their distinct pairs: text, key, times."""
    own = parts.numbers([text_parts(t) for t in doc_texts])
    whole = parts["intact"].astype(bool)
    if not whole[: len(parts.texts)].all():
        own = [x if whole[x].all() else [] for x in own]
    texts = parts.texts.__getitem__
    digests = [hashlib.sha256(b";".join(map(texts, x))).hexdigest() if x else "" for x in own]
    n, many = len(own), max(1, len(parts.texts))
    doc = np.repeat(np.arange(n), [len(x) for x in own])
    each, times = np.unique(doc * many + np.fromiter(chain.from_iterable(own), np.int64, len(doc)), return_counts=True)
    doc, part = each // many, each % many
    columns = {c: np.bincount(doc, times * parts[c][part], n).astype(np.int64) for c in COUNTS} | {"groups_sha256": digests}
    lengths = parts["pairs"][part]
    ends = np.cumsum(lengths)
    at = np.repeat(parts["first"][part] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
    room = parts.room
    pairs, where = np.unique(np.repeat(doc, lengths) * room + parts.keys.values[at], return_inverse=True)
    weights = np.bincount(where, parts.weights.values[at] * np.repeat(times, lengths), len(pairs)).astype(np.int64)
    return columns, pairs // room, pairs % room, weights


def _packed(slots: np.ndarray, weights: np.ndarray) -> bytes:
    """Ascending slots as differences, and weights, byte by byte."""
    columns = np.concatenate([np.diff(slots, prepend=0), weights]).astype("<u8")
    return columns.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)
    n = len(columns) // 2
    return np.cumsum(columns[:n]), columns[n:]


_SCHEMA = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[kind]) for name, kind in (c.split() for c in LINKED.split(", "))])


def _rows(n: int, columns: dict) -> pa.RecordBatch:
    """A batch of the chunks' table; absent columns are null."""
    arrays = [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _chunk(number: int, gathered: list, n_b: int) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its documents, then its dictionary. Entries are looked up a batch at a time: no array is as long as the chunk."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    keys = np.empty(0, np.int32)
    for _, _, own, _ in gathered:
        keys = np.union1d(keys, own)
    docs = np.zeros(len(keys), np.int64)
    while gathered:
        columns, cuts, own, weights = gathered.pop(0)
        slots, n = np.searchsorted(keys, own), len(columns["doc_id"])
        docs += np.bincount(slots, minlength=len(keys))
        pairs = [press(_packed(slots[i:j], weights[i:j])) if j > i else b"" for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield _rows(n, columns | {"chunk": np.full(n, number), "pairs": pairs})
    for i in range(0, len(keys), 50_000):
        k = keys[i : i + 50_000]
        yield _rows(len(k), {"chunk": np.full(len(k), number), "slot": np.arange(i, i + len(k)), "a": k // n_b, "b": k % n_b, "docs": docs[i : i + 50_000]})


def _linker(a_path: str | None, b_path: str | None, entries: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered, held = Parts(Tokenizers(a_path, b_path)), [], 0
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            columns, doc, own, weights = _batch(batch.column("text").to_pylist(), parts)
            cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
            gathered.append((columns | {"doc_id": batch.column("doc_id")}, cuts, _narrow(own), _narrow(weights)))
            held += len(own)
            if held >= entries:
                yield from _chunk(number, gathered, parts.library.n_b)
                number, gathered, held = number + 1, [], 0
        if gathered:
            yield from _chunk(number, gathered, parts.library.n_b)

    return link


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and the groups of each text, in order: their bytes [start, end) of blank + text, their A and their B ids."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = Tokenizers(a_path, b_path)
        for batch in batches:
            out = []
            for text in batch["text"]:
                parts = text_parts(text)
                ids = library.encode(parts)
                if not all(map(intact, [library] * len(parts), parts, *ids)):
                    out.append([])
                    continue
                a, b = (list(chain.from_iterable(x)) for x in ids)
                ends = np.cumsum(library.a_lengths[a]).tolist() if a else []
                ranges = zip(*(x.tolist() for x in overlaps(ends, np.cumsum(library.b_lengths[b]).tolist() if b else [])), strict=True)
                out.append([{"start": ends[i0 - 1] if i0 else 0, "end": ends[i1 - 1], "a": a[i0:i1], "b": b[j0:j1]} for i0, i1, j0, j1 in ranges])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "groups": out})

    return docs.select("doc_id", "text").mapInPandas(released(align), "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, entries: int = CHUNK_ENTRIES) -> DataFrame:
    """The stored table of chunks: rows of documents (slot is null) and of dictionaries (a pair, and how many of the chunk's documents hold it)."""
    return stored(docs.select("doc_id", "text").mapInArrow(released(_linker(a_path, b_path, entries)), LINKED), "linked")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, n_docs, best: in how many documents each pair is linked, and whether no other pair of its A id is in more."""
    counts = stored(chunks.filter("slot IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("n_docs")), "pairs")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # at most as many rows as vocabulary A has ids
    return counts.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    press = zstandard.ZstdDecompressor().decompress
    counts, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    counts[known["slot"]], best[known["slot"]] = known["n_docs"], known["best"]
    sums = []
    for raw in docs["pairs"]:
        slots, weights = _unpacked(press(raw)) if raw else (np.empty(0, np.int64),) * 2
        sums.append((weights @ best[slots], weights @ counts[slots]))
    out = docs[["doc_id", *COUNTS, "groups_sha256"]].assign(n_best=[int(x) for x, _ in sums], count_sum=[int(x) for _, x in sums])
    return out[[c.split()[0] for c in SCORED.split(", ")]]


def link_scores(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, entries: int = CHUNK_ENTRIES) -> DataFrame:
    """Per document: its tokens, groups and links, how many links are their A id's commonest, and the sum of the links' counts."""
    chunks = linked(docs, a_path, b_path, entries)
    dictionary = chunks.filter("slot IS NOT NULL").select("chunk", "slot", "a", "b")
    known = dictionary.join(pair_counts(chunks), ["a", "b"]).select(F.col("chunk").alias("of"), "slot", "n_docs", "best")
    documents = chunks.filter("slot IS NULL").select("chunk", "doc_id", *COUNTS, "groups_sha256", "pairs")
    return documents.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(_score, SCORED)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
