"""Cross-tokenizer alignment against whole-text encoding and naive counting."""

import hashlib
import random
import tracemalloc
import types
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment as al

AWKWARD = [None, "", " ", "a", "  the  end ", "don't (stop) —x", "é中\n\n x", "a▁b", "<|endoftext|></s><s>", "x;\r\ny \r z", "\t　\xa0tab\x1c.", "The the of of the. " * 40, "x" * 6000, "中" * 3000, " " * 500, "😀 한국 it's"]


@pytest.fixture(scope="module")
def library():
    return al.Tokenizers()


def naive_groups(library, text):
    """Groups by encoding the whole text and intersecting sets of ends."""
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = library.a.encode(" " + text, add_special_tokens=False).ids, library.b.encode(text)
    ends = []
    for ids, of in ((a, library.a_bytes), (b, library.b_bytes)):
        if b"".join(of[i] for i in ids) != raw:
            return []
        at, own = 0, []
        for i in ids:
            at += len(of[i])
            own.append(at)
        ends.append(own)
    out, i0, j0 = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(cut, i0) + 1, ends[1].index(cut, j0) + 1
        out.append((a[i0:i], b[j0:j]))
        i0, j0 = i, j
    return out


def naive(library, rows):
    groups = [naive_groups(library, text) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (doc_id, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(n for pair, n in own.items() if count[pair] == most[pair[0]])
        sums = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * count[pair] for pair, n in own.items()))
        out.append((doc_id, *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def scored(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_galloping_finds_all_common_ends():
    rng = random.Random(5)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(2))
        assert al.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def test_parts_lie_between_tokens_of_both(library):
    rng, texts = random.Random(1), []
    for k in range(3000):
        some = rng.choices("ab the. ,'s \n\t\r  é中<|endoftext|>1-　\x1c\xa0(\"Z", k=rng.randint(0, 25)) if k % 2 else rng.choices(["the ", " don't", "\n\n", "  ", "</s>", "12", "한국", "😀", "...", "ing", "\r\n"], k=rng.randint(0, 8))
        texts.append("".join(some))
    for text in texts:
        parts = al.text_parts(text)
        a, b = ([i for ids in x for i in ids] for x in library.encode(parts))
        if text:
            assert a == library.a.encode(" " + text, add_special_tokens=False).ids and b == library.b.encode(text)


@pytest.mark.parametrize("entries", [al.CHUNK_ENTRIES, 5])
def test_scores_by_brute_force(spark, library, entries, monkeypatch):
    rows = list(enumerate(AWKWARD)) + [(3, AWKWARD[3]), (None, "no id here"), (77, AWKWARD[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("slot", F.lit(1)).withColumn("a", F.lit("x"))
    assert scored(al.link_scores(docs.repartition(3), entries=entries)) == naive(library, rows)


def test_long_groups_as_products(library, monkeypatch):
    texts = ["中" * 400 + "한국" * 50, "aaaa" * 300 + "bbb" * 77, "don't"]
    frames = []
    for most in (1, 4096):
        monkeypatch.setattr(al, "MOST_IN_ONE", most)
        frames.append(al._batch(texts, al.Parts(library)))
    (own, *pairs), (same, *again) = frames
    assert all(list(own[c]) == list(same[c]) for c in own) and all((x == y).all() for x, y in zip(pairs, again, strict=True))


def test_chunks_take_little_memory(monkeypatch):
    """A chunk's entries are held in 8 bytes, and its dictionary is built without arrays as long as the chunk."""
    rng, seen, chunk = random.Random(3), [], al._chunk
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(1500)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(1024)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": range(i, i + 128), "text": texts[i : i + 128]}) for i in range(0, 1024, 128)]

    def traced(number, gathered, n_b):
        entries, held = sum(len(g[2]) for g in gathered), sum(x.nbytes for g in gathered for x in g[1:])
        tracemalloc.start()
        for _ in chunk(number, gathered, n_b):
            seen.append((entries, held, tracemalloc.get_traced_memory()[1]))
            yield _
        tracemalloc.stop()

    monkeypatch.setattr(al, "_chunk", traced)
    monkeypatch.setattr(al, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    assert sum(b.column("doc_id").null_count == 0 for b in al._linker(None, None, al.CHUNK_ENTRIES)(iter(batches))) == 8
    entries, held, most = seen[7]
    assert entries > 300_000 and held < 10 * entries and most < 30 * entries


def test_numbers_beyond_32_bits_are_kept():
    grown = al._Growing()
    grown.extend([3, 2**31 - 1])
    assert grown.values.dtype == np.int32
    grown.extend(np.array([2.0**40]))
    grown.extend([])
    grown.extend(range(5000))
    assert grown.values[: grown.n].tolist() == [3, 2**31 - 1, 2**40, *range(5000)]


def test_groups_cover_the_bytes(spark, library):
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string").withColumn("groups", F.lit("clash"))
    for r in al.alignments(rows).collect():
        assert [(list(g.a), list(g.b)) for g in r.groups] == naive_groups(library, AWKWARD[r.doc_id])
        if r.groups:
            assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups[:-1])] and r.groups[-1].end == len((" " + AWKWARD[r.doc_id]).encode())


def test_empty_table(spark):
    assert al.link_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_by_brute_force(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert scored(al.op12_alignment(spark, small)) == naive(library, rows)
