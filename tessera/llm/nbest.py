"""N-best piece segmentation and its inverse.

The lattice of a text has an edge for every vocabulary piece; a path scores the sum of its pieces'
scores. Viterbi runs forward over the lattice, and its scores are the exact heuristic of an A* search
from the end backward, which yields segmentations best first. Letters that are no piece become their
bytes' pieces, at a score below every piece's.

No piece crosses a word start, nor stands over a letter and a sign behind it, so a text's lattice is a chain
of its parts' lattices. The n best of a text are the n best sums over its parts, of which only the n - 1
parts with the smallest step to their second segmentation can differ from their best: for every part the
best and that step are found, and the n best of those few. Workers remember both.

Defined results: null and empty texts have one empty segmentation with score 0; texts with fewer
segmentations than asked for give fewer rows; equal scores are ordered by the search, the same for
equal texts; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, table
from tessera.llm.langid import Lattice, by_places
from tessera.llm.segments import Memory, piece_library, piece_parts

N = 3
#: Below the lowest score of a piece: what a letter costs that is no piece.
PENALTY = 10.0
START = "▁"
#: Parts that a worker remembers with their n best.
SEARCHED = 20_000
#: Parts that a worker remembers with their best.
REMEMBERED = 800_000


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str | None = None):
        library = piece_library(path)
        size = library.get_piece_size()
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self.text = {i: library.id_to_piece(i) for i in plain}
        self.byte = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(size) if library.is_byte(i)}
        self.raw = [b""] * size  # by id, what it stands for
        for i, t in self.text.items():
            self.raw[i] = t.encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.lattice = Lattice({t: i for i, t in self.text.items()})
        self.score = np.array([library.get_score(i) for i in range(size)] + [0.0])
        self.score[-1] = min((s for s in self.score[plain] if s > -1e8), default=0.0) - PENALTY  # of a letter that is no piece

    def lattice_of(self, parts: list[str]):
        """The edges (part, start, end, piece) of the parts' lattices by start, and the forward Viterbi scores."""
        best = np.full((len(parts), max(map(len, parts)) + 1), -np.inf)
        best[:, 0] = 0
        edges = list(self.lattice.edges(parts))
        for s, e, words, pieces in edges:
            best[words, e] = np.maximum(best[words, e], best[words, s] + self.score[pieces])
        return edges, best

    def best(self, parts: list[str]) -> list[tuple[float, float, bytes]]:
        """For each part: the step from its best to its second score, its best score and ids.

        Along edges that keep the heuristic exact the search goes straight back to the start; the second
        score is the best of all paths through an edge beside them, by a Viterbi pass from the end."""
        edges, best = self.lattice_of(parts)
        count, width = best.shape
        rows, lengths = np.arange(count), np.array([len(p) for p in parts])
        after, second = np.full((count, width), -np.inf), np.full(count, -np.inf)
        after[rows, lengths] = 0
        from_, with_ = np.full((2, count, width), -1)
        total = best[rows, lengths]
        for s, e, words, pieces in edges:
            exact = best[words, s] + self.score[pieces] == best[words, e]
            exact &= with_[words, e] < 0
            from_[words[exact], e] = s
            with_[words[exact], e] = pieces[exact] & 0x7FFFFFFF
        table, at = np.full((count, width), -1, np.int64), lengths.copy()
        on_path = np.zeros((count, width), bool)
        column = width
        own = rows
        while len(own):
            column -= 1
            on_path[own, at[own]] = True
            table[own, column] = with_[own, at[own]]
            at[own] = from_[own, at[own]]
            own = own[at[own] > 0]
        for s, e, words, pieces in reversed(edges):
            value = self.score[pieces] + after[words, e]
            after[words, s] = np.maximum(after[words, s], value)
            beside = ~(on_path[words, e] & (from_[words, e] == s))
            second[words[beside]] = np.maximum(second[words[beside]], best[words[beside], s] + value[beside])
        odd = (table == 0x7FFFFFFF).any(axis=1)
        used = table >= 0
        raw, ends = table[used].astype(np.uint32).tobytes(), np.cumsum(used.sum(axis=1)) * 4
        begins = np.concatenate([[0], ends[:-1]])
        ids = [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero(odd):  # letters that are no piece become their bytes
            spelled, place = [], 0
            for piece in table[k][used[k]].tolist():
                spelled += [piece] if piece != 0x7FFFFFFF else [self.byte[b] for b in parts[k][place].encode()]
                place += len(self.text[piece]) if piece != 0x7FFFFFFF else 1
            ids[k] = np.array(spelled, np.uint32).tobytes()
        return list(zip((total - second).tolist(), total.tolist(), ids, strict=True))

    def nbest(self, parts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """The n best (score, ids) of each part, all searched in step: backward A* over as many queues as there
        are parts. A state's value is the score of a whole path, so beyond the n best states (less the paths
        found) a queue needs none, and each step takes the best state of every queue."""
        edges, best = self.lattice_of(parts)
        count, width = best.shape
        own, piece = (np.concatenate([e[k] for e in edges]) for k in (2, 3))
        start, end = (np.concatenate([np.full(len(e[2]), e[k]) for e in edges]) for k in (0, 1))
        order = np.argsort(own * width + end, kind="stable")
        own, start, piece = own[order], start[order], piece[order]
        into = np.searchsorted(own * width + end[order], np.arange(count * width + 1))
        score, ahead = self.score[piece], best[own, start]
        # States: the part, the place, the path's score so far, and its last edge and state before that.
        part, place = np.arange(count), np.array([len(p) for p in parts])
        value, path, last = best[part, place], np.zeros(count), np.full(count, -1)
        edges, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        states, left, done = 0, np.full(count, n), []
        while len(part):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))  # queues are sorted: the best states
            ended = first[place[first] == 0]
            done.append((part[ended], path[ended], last[ended]))
            left[part[ended]] -= 1
            open_ = first[place[first] > 0]
            at = part[open_] * width + place[open_]
            each = into[at + 1] - into[at]
            edge = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(into[at], each)
            own_path = np.repeat(path[open_], each) + score[edge]
            edges.append(edge)
            before.append(np.repeat(last[open_], each))
            rest = np.ones(len(part), bool)
            rest[first] = False
            new = (np.repeat(part[open_], each), start[edge], ahead[edge] + own_path, own_path, states + np.arange(len(edge)))
            states += len(edge)
            part, place, value, path, last = (np.concatenate([x[rest], y]) for x, y in zip((part, place, value, path, last), new, strict=True))
            order = np.lexsort((-value, part))
            part, place, value, path, last = (x[order] for x in (part, place, value, path, last))
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
            rank = np.arange(len(part)) - np.repeat(begin, np.diff(begin, append=len(part)))
            keep = rank < left[part]
            part, place, value, path, last = (x[keep] for x in (part, place, value, path, last))
        edges, before = np.concatenate(edges), np.concatenate(before)
        part, path, last = (np.concatenate(x) for x in zip(*done, strict=True))
        columns, at = [], last  # a path's states from its last one on are its pieces from left to right
        while (at >= 0).any():
            columns.append(np.where(at >= 0, edges[at], -1))
            at = np.where(at >= 0, before[at], -1)
        table = np.stack(columns, axis=1) if columns else np.zeros((len(part), 0), np.int64)
        lengths = (table >= 0).sum(axis=1).tolist()
        ids = np.where(table >= 0, piece[table], 0)
        odd = ((table >= 0) & (ids < 0)).any(axis=1)
        raw, size = ids.astype(np.uint32).tobytes(), 4 * table.shape[1]
        out: list[list[tuple[float, bytes]]] = [[] for _ in parts]
        for k, (i, total, length, spelled) in enumerate(zip(part.tolist(), path.tolist(), lengths, odd.tolist(), strict=True)):
            own_ids = raw[k * size : k * size + 4 * length]
            if spelled:  # letters that are no piece become their bytes
                pieces = [[x] if x >= 0 else [self.byte[b] for b in parts[i][start[e]].encode()] for x, e in zip(ids[k, :length].tolist(), table[k, :length].tolist(), strict=True)]
                own_ids = np.array([x for some in pieces for x in some], np.uint32).tobytes()
            out[i].append((total, own_ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian unsigned 32-bit): pieces and bytes joined, the added word start dropped."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.uint32).tolist()))
        return raw.decode(errors="replace").replace(START, " ").removeprefix(" ")


class Searcher:
    """The n best segmentations of whole texts, parts from memory."""

    def __init__(self, n: int = N, path: str | None = None):
        self.n, self.pieces = n, Pieces(path)
        self.memory = Memory(lambda parts: self._blocks(parts, self.pieces.best), REMEMBERED)
        self.searched = Memory(lambda parts: self._blocks(parts, lambda block: self.pieces.nbest(block, n)), SEARCHED)

    @staticmethod
    def _blocks(parts: list[str], search) -> list:
        found: list = [None] * len(parts)
        for block in by_places(parts):
            for k, result in zip(block, search([parts[k] for k in block]), strict=True):
                found[k] = result
        return found

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[float, bytes]]]:
        """For each text its n best (score, ids)."""
        parts = [piece_parts(t) if t else [] for t in texts]
        self.memory.learn(parts)
        known, near = [], []
        for own in parts:
            known.append(list(map(self.memory.__getitem__, own)))
            steps = np.array([k[0] for k in known[-1]])
            # Of several parts with equal steps any will do.
            near.append(np.argpartition(steps, self.n - 2)[: self.n - 1].tolist() if 1 < self.n <= len(steps) else range(len(steps) if self.n > 1 else 0))
        self.searched.learn([[own[at] for at in some] for own, some in zip(parts, near, strict=True)])
        for own, found, some in zip(parts, known, near, strict=True):
            ids = [k[2] for k in found]
            total = float(sum([k[1] for k in found]))
            combined: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            choices = {at: self.searched[own[at]] for at in some}
            for at, choice in choices.items():
                grown = [(loss + choice[0][0] - score, (*changed, (at, k))) for loss, changed in combined for k, (score, _) in enumerate(choice)]
                combined = heapq.nsmallest(self.n, grown, key=lambda x: x[0])
            out = []
            for loss, changed in combined:
                for at, k in changed:
                    ids[at] = choices[at][k][1]
                out.append((total - loss if loss else total, b"".join(ids)))
            yield out


def _encoder(n: int, path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(n, path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                texts = [t or "" for t in some["text"]]
                rows = []
                for doc, text, best in zip(some["doc_id"], texts, searcher.texts(texts), strict=True):
                    plain = text.replace(START, " ")
                    rows += [(doc, k, score, ids, searcher.pieces.decode(ids) == plain) for k, (score, ids) in enumerate(best, 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "ids", "round_trip"])

    return encode


def nbest(docs: DataFrame, n: int = N, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, rank (from 1), score, ids (little-endian unsigned 32-bit) of the n best segmentations of each text,
    and round_trip: the ids, decoded, give the text (with blanks for U+2581)."""
    path = tokenizer_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(released(_encoder(n, path)), "doc_id string, rank int, score double, ids binary, round_trip boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The rows of nbest() with their ``text``."""
    path = tokenizer_path or public_tokenizers.path("piece_bpe_32k.model")

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(path)
        for ids in batches:
            yield ids.map(pieces.decode)

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn("text", F.pandas_udf(texts, "string")("ids"))


def op7_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nbest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


QUERIES = {"op7_nbest": op7_nbest}
ORACLES: dict[str, str] = {}
