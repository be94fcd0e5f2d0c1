"""Language identification by unigrams marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary (its own letters-only
pieces; any other single letter has a floor). A word's probability in a language is the sum over all
its segmentations into pieces of the product of their probabilities, found by the forward algorithm;
a text's is the product over its words, and the languages' posterior follows with equal priors.

Fitting: word counts of a bounded number of documents a language (FIT_DOCS, dealt by a hash of the
id), then expectation maximisation by forward and backward sums over the distinct words, a Spark job
each round; what reaches the driver is bounded by pieces times languages. Prediction needs no
shuffle: a worker sums each distinct word once and remembers a bounded number of them.

Words are runs of letters in lower case, of any length: words of more than PRODUCTS letters, whose products
could leave a double's range, are summed in logarithms. Held-out documents are those whose crc32(doc_id as text)
mod 4 is 2; they, null texts and null languages are never learned from.

Defined results: null texts and texts without a letter get ``und`` with score 0; so does every text
where nothing could be learned; ties go to the language first by name; repeated rows give equal
rows; ``predict`` ignores other columns, ``keep_identified`` keeps all columns and needs only text (lang is
replaced or added; without lang or doc_id nothing is learned, and no document stays).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, stored, table
from tessera.llm.segments import Memory, piece_library

#: Documents a language that the model is fitted on at most, and the rounds of expectation maximisation.
FIT_DOCS, ROUNDS = 2500, 2
#: Added to every expected count; probability of a letter that is no piece.
SMOOTHING, FLOOR = 0.05, 1e-9
#: Letters up to which products stay within a double's range (FLOOR ** 31 is 1e-279), and distinct words that a worker counts before it passes them on.
PRODUCTS, COUNTED = 30, 100_000
#: Words that a worker remembers the sums of.
REMEMBERED = 120_000
#: Places of all words whose sums stand in memory at once.
PLACES = 1 << 16
#: Texts that are looked up together.
TEXTS = 64
#: A document is rejected below this score.
LEAST_SCORE = 0.34

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Letters-only lower-case pieces, with or without a word start, and their numbers."""
    library = piece_library(path)
    pieces = sorted({library.id_to_piece(i) for i in range(library.get_piece_size()) if not library.is_byte(i) and not library.is_control(i)})
    kept = [p for p in pieces if (own := p.removeprefix("▁")) and own.isalpha() and own == own.lower()]
    return {p: k for k, p in enumerate(kept)}


class Lattice:
    """All segmentations of many words at once: the pieces' trie, as a plain table for the commonest letters and
    a hash table of (state, letter) for all."""

    SLOTS, COMMON = 1 << 18, 31

    def __init__(self, pieces: dict[str, int]):
        states = {"": 0}
        for p in pieces:
            for end in range(1, len(p) + 1):
                states.setdefault(p[:end], len(states))
        self.piece = np.full(len(states), -1, np.int32)
        self.piece[[states[p] for p in pieces]] = list(pieces.values())
        self.longest = max(map(len, pieces), default=1)
        slots = max(self.SLOTS, 1 << (4 * len(states)).bit_length())
        self.keys, self.to, self.mask = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), slots - 1
        for prefix, state in states.items():
            if prefix:
                key = states[prefix[:-1]] << 21 | ord(prefix[-1])
                at = int(self._slot(np.array([key]))[0])
                while self.keys[at] >= 0:
                    at = (at + 1) & self.mask
                self.keys[at], self.to[at] = key, state

        common = [c for c, _ in Counter(p[-1] for p in states if p and ord(p[-1]) < 1 << 16).most_common(self.COMMON)]
        self.column = np.zeros(1 << 16, np.int64)  # by letter; 0: not a common one
        self.column[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        self.table = np.zeros((len(states), self.COMMON + 1), np.int32)
        for prefix, state in states.items():
            if prefix and ord(prefix[-1]) < 1 << 16:
                self.table[states[prefix[:-1]], self.column[ord(prefix[-1])]] = state

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 13) & self.mask

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one more letter, 0 where no piece goes on so."""
        column = self.column.take(letter, mode="clip") * (letter < 1 << 16)
        out = self.table[state, column]
        rare = np.flatnonzero(column == 0)
        if len(rare):
            out[rare] = self._hashed_step(state[rare], letter[rare])
        return out

    def _hashed_step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 21 | letter
        at = self._slot(key)
        out = np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def edges(self, words: list[str]):
        """(start, end, word numbers, pieces) of all places, by start; piece -1 is a letter that is no piece."""
        width = max(map(len, words))
        letters = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        for start in range(width):
            own = np.flatnonzero(lengths > start)
            state = np.zeros(len(own), np.int32)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                state = self.step(state, letters[own, end - 1])
                piece = np.where(state > 0, self.piece[state], -1)
                use = (piece >= 0) if end > start + 1 else slice(None)
                if len(own[use]):
                    yield start, end, own[use], piece[use]
                alive = (state > 0) & (lengths[own] > end)
                own, state = own[alive], state[alive]
                if not len(own):
                    break


def started(words: list[str]) -> list[str]:
    return ["▁" + w for w in words]


def by_places(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words, in blocks of similar length and bounded places."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        n = max(1, PLACES // (len(words[order[at]]) + 2))
        while n > 1 and n * (len(words[order[min(at + n, len(order)) - 1]]) + 2) > 2 * PLACES:
            n //= 2
        yield order[at : at + n]
        at += n


def _add(logarithms: bool, sums: np.ndarray, at, more: np.ndarray) -> None:
    sums[at] = np.logaddexp(sums[at], more) if logarithms else sums[at] + more


def forward(lattice: Lattice, words: list[str], probability: np.ndarray) -> np.ndarray:
    """Words x languages: logarithms of the sums over all segmentations. probability: pieces x languages, the floor last."""
    out, logs = np.zeros((len(words), probability.shape[1])), np.log(probability)
    for block in by_places(words):
        own_words = started([words[k] for k in block])
        lengths = np.array([len(w) for w in own_words])
        long_ = lengths.max() > PRODUCTS + 1
        sums = np.full((len(block), int(lengths.max()) + 1, probability.shape[1]), -np.inf if long_ else 0.0)
        sums[:, 0] = 0 if long_ else 1
        for start, end, own, piece in lattice.edges(own_words):
            _add(long_, sums, (own, end), sums[own, start] + logs[piece] if long_ else sums[own, start] * probability[piece])
        last = sums[np.arange(len(block)), lengths]
        out[block] = last if long_ else np.log(last)
    return out


def expected_counts(lattice: Lattice, words: list[str], langs: np.ndarray, times: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Pieces x languages (letters that are no piece last): how often each piece is expected in the words."""
    out, logs = np.zeros(probability.size), np.log(probability)
    for block in by_places(words):
        own_words, lang, n = started([words[k] for k in block]), langs[block], times[block]
        lengths, rows = np.array([len(w) for w in own_words]), np.arange(len(block))
        long_ = lengths.max() > PRODUCTS + 1
        edges = list(lattice.edges(own_words))
        before, after = np.full((2, len(block), int(lengths.max()) + 1), -np.inf if long_ else 0.0)
        before[:, 0] = after[rows, lengths] = 0 if long_ else 1
        for start, end, own, piece in edges:
            _add(long_, before, (own, end), before[own, start] + logs[piece, lang[own]] if long_ else before[own, start] * probability[piece, lang[own]])
        total = before[rows, lengths]
        for start, end, own, piece in reversed(edges):
            on = after[own, end] + logs[piece, lang[own]] if long_ else after[own, end] * probability[piece, lang[own]]
            _add(long_, after, (own, start), on)
            share = np.exp(before[own, start] + on - total[own]) if long_ else before[own, start] * on / total[own]
            cell = np.where(piece < 0, len(probability) - 1, piece) * probability.shape[1] + lang[own]
            out += np.bincount(cell, n[own] * share, len(out))
    return out.reshape(probability.shape)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.update((lang, w) for w in words_of(text))
        if len(counts) > COUNTED:
            yield rows()
            counts.clear()
    yield rows()


def _expect(langs: list[str], probability: np.ndarray, path: str | None):
    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, at = Lattice(vocabulary(path)), {lang: k for k, lang in enumerate(langs)}
        expected = np.zeros(probability.shape)
        for b in batches:
            if len(b):
                expected += expected_counts(lattice, list(b["word"]), b["lang"].map(at).to_numpy(), b["n"].to_numpy(float), probability)
        k, lang = np.nonzero(expected[:-1])
        yield pd.DataFrame({"piece": k.astype(np.int32), "lang": lang.astype(np.int32), "n": expected[k, lang]})

    return expect


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages by name and their piece probabilities (pieces x languages, the floor last)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    shares = {r["lang"]: min(1.0, fit_docs / r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = vocabulary(path)
    langs = sorted(shares)
    probability = np.full((len(pieces) + 1, len(langs)), 1 / max(1, len(pieces)))
    probability[-1] = FLOOR
    if not langs:
        return langs, probability
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")]
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fit")), F.lit(1_000_000)) < share * 1_000_000
    counted = labelled.filter(dealt).select("lang", "text").mapInPandas(released(_count_words), "lang string, word string, n long")
    counts = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        expected = counts.mapInPandas(released(_expect(langs, probability, path)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full((len(pieces), len(langs)), SMOOTHING)
        sums[expected["piece"], expected["lang"]] += expected["n"]
        probability = np.vstack([sums / sums.sum(axis=0), probability[-1:]])
    return langs, probability


def _predict(langs: list[str], probability: np.ndarray, path: str | None):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(vocabulary(path))
        memory = Memory(lambda words: [row.tobytes() for row in forward(lattice, words, probability)], REMEMBERED)
        for batch in batches:
            texts, lang, score = batch.tolist(), [], []
            for at in range(0, len(texts), TEXTS):
                words = [words_of(t) if t else [] for t in texts[at : at + TEXTS]]
                if langs:
                    memory.learn(words)
                for own in words:
                    if not langs or not has_letter(own):
                        lang.append("und")
                        score.append(0.0)
                        continue
                    total = np.frombuffer(b"".join(map(memory.__getitem__, own))).reshape(-1, len(langs)).sum(axis=0)
                    posterior = np.exp(total - total.max())
                    best = int(total.argmax())
                    lang.append(langs[best])
                    score.append(float(posterior[best] / posterior.sum()))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    predict = released(predict)
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not deterministic as far as the optimizer is concerned, which would else predict once for each use of the result.
    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _predict(*model, path)(F.col("text").cast("string")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, path: str | None = None) -> DataFrame:
    """The documents whose language is identified, with all their columns; lang becomes the prediction."""
    known = docs
    for name, kind in (("doc_id", "long"), ("lang", "string")):
        known = known if name in docs.columns else known.withColumn(name, F.lit(None).cast(kind))
    model = fit(known.select("doc_id", "text", "lang"), path=path)
    found = docs.withColumn(_FOUND, _predict(*model, path)(F.col("text").cast("string")))
    found = found.filter((F.col(_FOUND)["lang_pred"] != "und") & (F.col(_FOUND)["score"] >= least_score))
    return found.withColumn("lang", F.col(_FOUND)["lang_pred"]).drop(_FOUND)


#: A name that no column of the documents has.
_FOUND = "__tessera_language"


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))


QUERIES = {"op6_langid": op6_langid}
ORACLES: dict[str, str] = {}
