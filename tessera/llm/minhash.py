"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Texts become lower-case words and five-word shingles (a shorter text is one shingle). A 64-bit
   digest of the words names a text; copies share it and are one node from here on.
2. A shingle weighs (1 + ln tf) * (1 + ln min(N / df, 1 / RARE)): a shingle that fewer than a share RARE of
   the documents hold is rare, and beyond that its weight grows no more (else the few changed shingles of
   near copies would outweigh the many common ones). Only frequencies above that share matter, and a
   cell of the count sketch holds a share of N that does not depend on N (the mean shingles of a document
   over CELLS, about 0.1 %), so the sketch stays good at any corpus size.
3. BANDS x ROWS weighted samples a text, banded: at similarity 0.8 a pair shares no band with
   probability 2e-4, at 0.9 with 1e-7.
4. In a bucket of at most SMALL texts all pairs are verified by exact weighted Jaccard similarity.
5. Texts of larger buckets are sampled again with DENSE_BANDS x DENSE_ROWS: long keys tell the many texts of
   similarity 0.6 apart that short keys lump together (at 0.8 a pair of them shares a key with probability
   0.996, at 0.85 with 0.999999). There every text is first verified against one leader of its bucket, the
   links are joined to classes, and then every pair of a bucket whose texts are not of one class yet is
   verified, unless what either text shares with any other dense text is too little: with weights W and,
   of these, C in shingles of two or more dense texts, a pair's similarity is at most m / (W + W' - m),
   m = min(C, C'). So each pair of such a bucket is verified, is of one class already, or cannot be alike.
6. Links are joined to classes by spreading the least node, a Spark job a step.

Tables between the steps lie in the shared folder, so adaptive execution can split hot keys and a
lost executor costs one step's tasks; superseded tables are deleted.

Defined results: null texts are empty; all empty texts are copies of each other; repeated rows get
equal classes; null ids take part like others; a class's id is its least doc_id (its least digest where
all ids are null), and where one id has texts of several classes ``label`` tells these apart; other columns
are ignored. Digests have 64 bits.
"""

from __future__ import annotations

import functools
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, released, stored, table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
DENSE_BANDS, DENSE_ROWS = 192, 16
CELLS, RARE = 1 << 18, 0.02
#: Texts of a bucket that are all compared with each other at once.
SMALL = 16
SEED = 20240229
#: Digests that a task remembers so as not to sign copies again; texts whose shingles a task remembers.
SEEN, REMEMBERED_TEXTS = 100_000, 256
#: Characters whose words are hashed together.
BLOCK = 1 << 18
#: Shingles that are sampled together, and cells (shingles x samples) that stand in memory at once.
SAMPLED, SAMPLE_CELLS = 8192, 1 << 19

_CUT = re.compile(r"\W")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROWS_OF_SKETCH = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


@functools.cache
def _is_word() -> np.ndarray:
    """By code point: a letter, digit or underscore."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    odd = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (odd, pow(odd, -1, 1 << 64)))


def _hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text in lower case starts, and its hash: a polynomial over its code points."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    change = np.flatnonzero(np.diff(_is_word()[code], prepend=False, append=False))
    start, end = change[::2], change[1::2]
    power, inverse = (x[: len(code)] for x in _powers(max(2 * BLOCK, 1 << len(code).bit_length())))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint32(1)) * power)])
    words = (sums[end] - sums[start]) * inverse[start]
    words = (words ^ words >> np.uint64(32)) * _MIX
    return start, words ^ words >> np.uint64(29)


def _blocks(text: str) -> Iterator[str]:
    """A text in blocks of about BLOCK characters that end after no word's inside."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + BLOCK)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text."""
    out, held, size = [], [], 0

    def hash_held():
        begin = np.cumsum([0, *(len(t) + 1 for t in held)])
        start, words = _hashed_words("\n".join(held))
        cuts = np.searchsorted(start, begin)
        out.extend(words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        held.clear()

    for text in texts:
        text = (text or "").lower()
        if held and size + len(text) > BLOCK:
            hash_held()
            size = 0
        if len(text) > BLOCK:
            out.append(np.concatenate([_hashed_words(b)[1] for b in _blocks(text)]))
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        hash_held()
    return out


def digest(words: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(words.tobytes(), SEED) - (1 << 63)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and how often each occurs."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total = (total ^ words[k : k + n]) * _MIX
        total ^= total >> np.uint64(29)
    total.sort()
    first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
    return total[first], np.diff(first, append=n)


def cells_of(hashes: np.ndarray, row: int) -> np.ndarray:
    return ((hashes * _ROWS_OF_SKETCH[row]) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


class Weights:
    """TF-IDF weights from the sketch of document frequencies (its rows x CELLS numbers)."""

    def __init__(self, sketch: np.ndarray, documents: int):
        noise = (sketch.sum(axis=1, keepdims=True) - sketch) / (CELLS - 1)
        share = np.clip((sketch - noise) / max(documents, 1), RARE, 1)
        self.idf = (1 - np.log(share)).astype(np.float32)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = self.idf[0][cells_of(hashes, 0)]
        for row in range(1, len(self.idf)):  # each row can only count too much
            idf = np.maximum(idf, self.idf[row][cells_of(hashes, row)])
        return (1 + np.log(counts, dtype=np.float32)) * idf


class Sampler:
    """Keys of texts by improved consistent weighted sampling; the random draws of a (shingle, sample)
    come from tables by a hash of both.

    A sample is the shingle with the least log a = log c - r (t - beta + 1), t = floor(log w / r + beta), which
    lies in [log c - r - log w, log c - log w). The tables are sorted by log c - r, so the leading bits of the hash
    bound log a, and only shingles that may come below a limit are worked out; where none does, all are."""

    BITS, SHARE = 14, 4.0

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = 1 << self.BITS
        r, log_c = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size))
        order = np.argsort(log_c - r)
        self.r, self.log_c, self.low = (x[order].astype(np.float32) for x in (r, log_c, log_c - r))
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def _worth(self, z: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log a and t of drawn hashes."""
        draw = z >> np.uint32(32 - self.BITS)
        beta = ((z >> np.uint32(32 - 2 * self.BITS)) & np.uint32((1 << self.BITS) - 1)).astype(np.float32) * np.float32(2.0**-self.BITS)
        r = self.r[draw]
        t = np.floor(log_w / r + beta)
        return self.log_c[draw] - r * (t - beta + 1), t

    @staticmethod
    def _where(mask: np.ndarray) -> np.ndarray:
        """np.flatnonzero of few hits, eight cells at a time."""
        words = mask.ravel().view(np.uint64)
        some = np.flatnonzero(words)
        hits = np.flatnonzero(words[some].view(bool))
        return some[hits >> 3] * 8 + (hits & 7)

    @staticmethod
    def _least(group: np.ndarray, log_a: np.ndarray) -> np.ndarray:
        """Where each run of equal groups has its (first) least value."""
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(log_a, first)
        hits = np.flatnonzero(log_a == np.repeat(least, np.diff(first, append=len(group))))
        return hits[np.concatenate([[True], group[hits][1:] != group[hits][:-1]])]

    def keys(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts x bands; ``texts``: each one's shingle hashes (at least one) and their weights."""
        lengths = np.array([len(h) for h, _ in texts])
        hashes, log_w = np.concatenate([h for h, _ in texts]), np.log(np.concatenate([w for _, w in texts]))
        of, begin = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
        limit = np.log(self.SHARE / np.add.reduceat(np.exp(log_w), begin)).astype(np.float32)
        bound = np.minimum(np.searchsorted(self.low, limit[of] + log_w), len(self.low) - 1).astype(np.uint32) << np.uint32(32 - self.BITS)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        limit = np.minimum(limit, self.low[-1] - np.maximum.reduceat(log_w, begin))  # beyond the tables nothing is sure
        chosen = np.zeros((len(self.factor), len(texts)), np.uint64)
        step = max(8, SAMPLE_CELLS // len(hashes) // 8 * 8)
        for at in range(0, len(self.factor), step):
            z = self.factor[at : at + step, None] * short
            cell = self._where(z < bound)
            sample, shingle = np.divmod(cell, len(hashes))
            log_a, t = self._worth(z.ravel()[cell], log_w[shingle])
            group = sample * len(texts) + of[shingle]
            open_ = np.ones(len(z) * len(texts), bool)
            if len(group):
                best = self._least(group, log_a)
                best = best[log_a[best] < limit[of[shingle[best]]]]
                chosen[at + sample[best], of[shingle[best]]] = hashes[shingle[best]] + t[best].astype(np.int64).astype(np.uint64)
                open_[group[best]] = False
            rest = np.flatnonzero(open_)
            if len(rest):
                text = rest % len(texts)
                each = lengths[text]
                group = np.repeat(np.arange(len(rest)), each)
                shingle = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each) + begin[text][group]
                log_a, t = self._worth(self.factor[at + rest // len(texts)][group] * short[shingle], log_w[shingle])
                best = self._least(group, log_a)
                chosen[at + rest // len(texts), text] = hashes[shingle[best]] + t[best].astype(np.int64).astype(np.uint64)
        chosen = (chosen * _MIX).reshape(self.bands, self.rows, len(texts))
        keys = np.arange(self.bands, dtype=np.uint64)[:, None] * np.ones(len(texts), np.uint64)
        for k in range(self.rows):
            keys = (keys ^ chosen[:, k]) * _MIX
            keys ^= keys >> np.uint64(31)
        return keys.T.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' sorted distinct shingles and their weights."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][at], b[1][bt]).sum(dtype=float)
    high = a[1].sum(dtype=float) + b[1].sum(dtype=float) - low
    return low / high if high else 1.0


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, row, node) and, at the end, (cell, count) with no row."""
    sketch = np.zeros(len(_ROWS_OF_SKETCH) * CELLS, np.int64)
    for batch in batches:
        texts = hashed_texts(batch["text"].tolist())
        if texts:
            all_ = np.concatenate([shingles(words)[0] for words in texts])
            for row in range(len(_ROWS_OF_SKETCH)):
                sketch[row * CELLS : (row + 1) * CELLS] += np.bincount(cells_of(all_, row), minlength=CELLS)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "row": batch["row"], "key": [digest(w) for w in texts], "n": 0})
    used = np.flatnonzero(sketch)
    yield pd.DataFrame({"doc_id": None, "row": None, "key": used, "n": sketch[used]})


def _signer(weights, bands: int, rows: int):
    """(node, k0, k1, ...) of texts that are not empty, copies mostly once a task."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, seen, weigh = Sampler(bands, rows), set(), weights.value
        columns = ["node", *(f"k{b}" for b in range(bands))]
        for batch in batches:
            nodes, texts, out, held = [], [], [], 0

            def sampled():
                keys = sampler.keys(texts)
                out.append(np.column_stack([np.array(nodes, np.int64), keys]))
                nodes.clear()
                texts.clear()

            for words in hashed_texts(batch["text"].tolist()):
                node = digest(words)
                if len(words) and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    hashes, counts = shingles(words)
                    if texts and held + len(hashes) > SAMPLED:
                        sampled()
                        held = 0
                    nodes.append(node)
                    texts.append((hashes, weigh(hashes, counts)))
                    held += len(hashes)
            if texts:
                sampled()
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=columns)

    return sign


def banded(texts: DataFrame, weights, bands: int, rows: int) -> DataFrame:
    """(node, key) of each distinct text and band."""
    names = [f"k{b}" for b in range(bands)]
    signed = texts.select("text").mapInPandas(released(_signer(weights, bands, rows)), "node long, " + ", ".join(f"{k} long" for k in names))
    once = signed.groupBy("node").agg(*(F.max(k).alias(k) for k in names))
    return once.select("node", F.explode(F.array(*names)).alias("key"))


def densely_banded(texts: DataFrame, weights) -> DataFrame:
    """(node, key) of distinct texts and the bands of the longer keys."""
    sign = _signer(weights, DENSE_BANDS, DENSE_ROWS)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys in sign(batches):
            yield pd.DataFrame({"node": np.repeat(keys["node"].to_numpy(), DENSE_BANDS), "key": keys.iloc[:, 1:].to_numpy().ravel()})

    return texts.select("text").mapInPandas(released(listed), "node long, key long")


def _shared_weights(texts: DataFrame, weights) -> DataFrame:
    """(node, total, common) of distinct texts: the weight of all shingles, and of those that another text has too."""

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in hashed_texts(batch["text"].tolist()):
                hashes, counts = shingles(words)
                yield pd.DataFrame({"node": digest(words), "shingle": hashes.view(np.int64), "weight": weights.value(hashes, counts)})

    rows = texts.select("text").mapInPandas(released(weighed), "node long, shingle long, weight double")
    held = stored(rows, "shingles")
    alone = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).filter("n = 1")
    own = alone.groupBy("node").agg(F.sum("weight").alias("alone"))
    totals = held.groupBy("node").agg(F.sum("weight").alias("total"))
    out = stored(totals.join(own, "node", "left").select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("common")), "weights")
    dropped(held)
    return out


def _verifier(weights):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh, known = weights.value, OrderedDict()

        def weighed(node: int, text: str):
            if node not in known:
                hashes, counts = shingles(hashed_texts([text])[0])
                known[node] = hashes, weigh(hashes, counts)
                if len(known) > REMEMBERED_TEXTS:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            alike = [weighted_jaccard(weighed(a, s), weighed(b, t)) for a, s, b, t in zip(batch["rep"], batch["rep_text"], batch["node"], batch["text"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "rep": batch["rep"], "similarity": alike})

    return verify


def verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """(node, rep, similarity), stored, of pairs (node, rep)."""
    asked = stored(pairs, "pairs")
    both = asked.join(texts, "node").join(texts.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep")
    out = stored(both.mapInPandas(released(_verifier(weights)), "node long, rep long, similarity double"), "verified")
    dropped(asked)
    return out


def row_key() -> Column:
    """Names a row by its id and text; repeated rows share it."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, node, n) of the buckets that hold n > 1 texts."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    return keyed.join(sizes.select("key", "n"), "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "rep").alias("node"), F.greatest("node", "rep").alias("rep")).distinct()


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Headers (doc_id, row, node) of all rows, and the verified links (node, rep, similarity) between different texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    keyed_rows = rows.withColumn("row", row_key())
    first = stored(keyed_rows.withColumn("row", F.col("row").cast("string")).mapInPandas(released(_first_pass), "doc_id string, row string, key long, n long"), "digests")
    headers = first.filter("n = 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row").cast("long").alias("row"), F.col("key").alias("node"))
    counted = first.filter("n > 0").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # 2 x CELLS rows at most
    sketch = np.zeros(len(_ROWS_OF_SKETCH) * CELLS, np.int64)
    sketch[counted["key"]] = counted["n"]
    weights = spark.sparkContext.broadcast(Weights(sketch.reshape(len(_ROWS_OF_SKETCH), CELLS), headers.count()))

    keyed = stored(banded(rows, weights, BANDS, ROWS), "bands")
    own = stored(_shared(keyed), "buckets")
    dropped(keyed)
    wanted = own.select("node").distinct().join(headers.groupBy("node").agg(F.min("row").alias("row")), "node")
    texts = stored(wanted.join(keyed_rows.select("row", "text"), "row").groupBy("node").agg(F.max("text").alias("text")), "texts")

    few = own.filter(F.col("n") <= SMALL).select("key", "node")
    pairs = _ordered(few.join(few.withColumnRenamed("node", "rep"), "key").filter("node < rep"))
    tested = verified(pairs, texts, weights)

    dense = own.filter(F.col("n") > SMALL).select("node").distinct().join(texts, "node")
    dense_keys = stored(densely_banded(dense, weights), "dense-bands")
    own_dense = stored(_shared(dense_keys).select("key", "node"), "dense-buckets")
    dropped(dense_keys)
    leaders = own_dense.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(SEED)).alias("rank"), "node"))["node"].alias("rep"))
    pairs = _ordered(own_dense.join(leaders, "key").filter("node <> rep"))
    led = verified(pairs.join(tested.select("node", "rep"), ["node", "rep"], "left_anti"), texts, weights)
    links_of = lambda *parts: stored(_union(parts).filter(F.col("similarity") >= threshold), "links")
    so_far = links_of(tested, led)
    labels = components(so_far)
    sums = _shared_weights(dense, weights)
    named = own_dense.join(labels, "node", "left").join(sums, "node").select("key", "node", F.coalesce("label", "node").alias("label"), "total", "common")
    named = stored(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key")
    open_ = stored(named.join(mixed, "key"), "open")
    others = open_.select("key", F.col("node").alias("rep"), F.col("label").alias("other"), F.col("total").alias("total2"), F.col("common").alias("common2"))
    least = threshold / (1 + threshold) * (1 - 1e-4)  # a little lower, against rounding
    alike = F.least("common", "common2") >= least * (F.col("total") + F.col("total2"))
    pairs = _ordered(open_.join(others, "key").filter("node < rep and label <> other").filter(alike))
    known = tested.select("node", "rep").union(led.select("node", "rep"))
    last = verified(pairs.join(known, ["node", "rep"], "left_anti"), texts, weights)
    edges = links_of(tested, led, last)
    dropped(texts, own, own_dense, sums, named, open_, so_far, tested, led, last, labels)
    return headers, edges


def _union(parts) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node in ``edges`` (a stored table of node, rep)."""
    both = stored(edges.select(F.col("node").alias("u"), F.col("rep").alias("v")).union(edges.select("rep", "node")), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    while True:
        # The least label of a node and its neighbours, then the label of that node.
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "lower").select("node", "old", F.least("lower", "further").alias("label")), "labels")
        dropped(labels)
        labels = after.select("node", "label")
        labels.stored_at = after.stored_at
        if after.filter("old <> label").isEmpty():
            dropped(both)
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, class_id, label (the class's least digest), n_links (verified links of the row's text), copies
    (rows with its words) of every row."""
    headers, edges = links(docs, threshold)
    nodes = headers.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    ends = edges.select("node").union(edges.select("rep")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = stored(
        nodes.join(components(edges), "node", "left").join(ends, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")),
        "nodes",
    )
    firsts = stored(known.groupBy("label").agg(F.min("first").alias("class_id")), "classes")
    named = stored(known.join(firsts, "label").select("node", F.coalesce("class_id", "label").alias("class_id"), "label", "n_links", "copies"), "named")
    return headers.join(named, "node").select("doc_id", "row", "class_id", "label", "n_links", "copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns: that with the least doc_id (null ids come last; of equal
    ids that with the least digest, of repeated rows any). Null texts are empty, and all empty texts are one class."""
    found = stored(classes(docs, threshold).select("label", "doc_id", "row"), "kept")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"]
    kept = found.groupBy("label").agg(first.alias("row")).select(F.col("row").alias(_KEPT)).distinct()
    keyed = docs.withColumn(_KEY, F.xxhash64(F.col("doc_id").cast("string").isNull(), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))
    return keyed.join(kept, F.col(_KEY) == F.col(_KEPT), "left_semi").dropDuplicates([_KEY]).drop(_KEY)


#: Names that no column of the documents has.
_KEY, _KEPT = "__tessera_row", "__tessera_kept"


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row", "label")


QUERIES = {"op9_minhash": op9_minhash}
ORACLES: dict[str, str] = {}
