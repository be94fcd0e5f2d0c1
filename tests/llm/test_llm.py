"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import counts, imatch, knn, langid, licenses, minhash, nbest, packing, pii, segments, warc
from tessera.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "a", "é中\n", "Mail a@b.co now", "card 4539 1488 0343 6467", "x" * 5000, "one two three four five six seven"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(AWKWARD)] + [(5, AWKWARD[5], "en", "s", 15), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("key", F.lit(2))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_by_brute_force():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choices("a1@.+- ()9é", k=rng.randint(0, 40)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_pii_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("my ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    assert pii.redact("a@b.co, 10.0.0.1") == "[EMAIL], [IP]" and pii.redact(None) is None
    assert len(pii.find_spans("1" * 200_000)) == 0  # linear in a long run


def test_ibans_before_words_and_beside_cards():
    kinds = lambda text: [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)]
    assert ("iban", "GB82WEST12345698765432") in kinds("IBAN GB82WEST12345698765432 OK")
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("IBAN GB82 WEST 1234 5698 7654 32 AND MORE")
    assert [x for k, x in kinds("IBAN GB82WEST12345698765432 DE89370400440532013000") if k == "iban"] == ["GB82WEST12345698765432", "DE89370400440532013000"]
    assert not [k for k, _ in kinds("IBAN GB83WEST12345698765432 OK") if k == "iban"]
    assert [k for k, _ in kinds("IMEI 490154203237518")] == ["card", "imei"]


def test_pii_query(spark, docs):
    rows = pii.with_spans(docs).collect()
    assert len(rows) == docs.count() and all([tuple(s)[:3] for s in r.pii_spans if s.kind in pii.BASE_KINDS] == base_spans(r.text or "") for r in rows)


def test_licenses(spark):
    cases = {"MIT": "x. Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "NONE": "nothing here", "UNKNOWN": "You may obtain a copy of the License at z.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rows = spark.createDataFrame([(k, t, "clash") for k, t in cases.items()] + [("NONE", None, ""), ("NONE", "", "")], "doc_id string, text string, licence string")
    assert all(r.doc_id == r.licence for r in licenses.scan(rows).collect())


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(0, 1, (300, 8)), np.repeat(rng.normal(0, 1, (1, 8)), 60, axis=0)])
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (None, [0.0] * 8)]
    got = {}
    table = knn.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for r in knn.top_k(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * v).astype(np.int64)
    for k in range(0, len(v), 50):
        score = q @ q[k]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != k)[:5]
        assert sorted(got[k]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert knn.top_k(table.limit(0), table.limit(0)).count() == 0


def test_rings_spare_far_cells_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(knn, "BLOCK", 64)
    made, rings = [], knn.rings
    monkeypatch.setattr(knn, "rings", lambda *a: made.append(rings(*a)) or made[-1])
    rng = np.random.default_rng(8)
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0][:20]
    v = np.vstack([c + rng.normal(0, 0.01, (60, 24)) for c in centres])
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = knn.integers(spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>"))
    asked = table.filter("vec_id % 15 = 0")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(table, asked, pivots=100).collect()}
    q = np.floor(256 * v).astype(np.int64)
    for k in range(0, len(v), 15):
        best = sorted((-int(s), i) for i, s in enumerate(q @ q[k]) if i != k)[:5]
        assert [got[k, n] for n in range(1, 6)] == [(i, -s) for s, i in best]
    (copies,) = made
    groups = copies["group"].nunique()
    assert groups >= 10 and len(copies) < 0.5 * 100 * groups
    assert knn.top_k(table.limit(0), asked).count() == 0


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 200
    rows = [(1, "u", long), (2, None, long), (3, "u v", long + "WARC/1.1\r\n\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "u", long), (9, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    mark = warc.write_archives(warc.resolve_revisits(pages), path)
    read = warc.read_archives(spark, path, mark).collect()
    assert len(read) == len(rows)
    for r in read:
        raw = next((h or "") for k, _, h in rows if k == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if r.page_id in (1, 2) else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    expected = []
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [0]
        expected += [(d.doc_id, k // 64, k, len(ids[k : k + 64]), struct.pack(f"<{len(ids[k : k + 64])}I", *ids[k : k + 64])) for k in range(0, len(ids), 64)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, bytes(r.ids))) for r in rows)
    for _, own in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in rows), key=lambda r: r[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 64


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(0, 80))), reverse=True)
        gaps: list[int] = []
        for s in sizes:
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 30) - s)
        runs = packing.sweep({s: sizes.count(s) for s in set(sizes)}, 30)
        used = {}
        for length, a, b, first, each, base in runs:
            for k in range(b - a):
                used.setdefault(first + k // each, []).append((base + k % each * length, length))
        assert len(used) == len(gaps) and sum(map(len, used.values())) == len(sizes)
        for own in used.values():
            own.sort()
            assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 30


def test_parts_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), segments.piece_library()
    words, numbers, rng = segments.word_memory(), segments.piece_count_memory(), random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choices(["a", "B", "é", " ", "\n", "\x1c", "▁", "Σ", "'s", "<|endoftext|>", "0", "-", "́", "中", ".", "ſ", ",", "|", "²", "ß", "À", "'ll", "\""], k=rng.randint(0, 20)))
        own, other = segments.word_parts(text), segments.piece_parts(text)
        words.learn([own])
        numbers.learn([other])
        ids = library.encode(text, add_special_tokens=False).ids
        assert b"".join(words[p] for p in own) == struct.pack(f"<{len(ids)}I", *ids), text
        assert sum(numbers[p] for p in other) == len(pieces.encode(text))


def test_language(spark):
    rng = random.Random(8)
    words = {"en": "the house is on a hill and that was there".split(), "fr": "le chat est dans une maison que nous avons".split()}
    rows = [(k, " ".join(rng.choices(words[lang], k=20)), lang, "s", 1) for k in range(120) for lang in [("en", "fr")[k % 2]]] + [(500, None, "en", "s", 0), (501, "123 !", None, "s", 0), (None, "le chat", "fr", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(found[k].lang_pred == ("en", "fr")[k % 2] and found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(120))
    assert found[500].lang_pred == found[501].lang_pred == "und" and found[None].lang_pred == "fr"
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {*range(120), None}


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "bb": 5}
    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [1e-9]])
    lattice = langid.Lattice(pieces)

    def brute(word):
        if not word:
            return 1.0
        return sum((p[pieces[word[:k]], 0] if word[:k] in pieces else 1e-9 if k == 1 else 0) * brute(word[k:]) for k in range(1, len(word) + 1))

    words = ["ab", "abb", "b", "ca", "bbb"]
    assert np.allclose(np.exp(langid.forward(lattice, words, p)[:, 0]), [brute("▁" + w) for w in words], rtol=1e-12)

    def segmentations(word):  # (log probability, pieces) of each
        if not word:
            return [(0.0, ())]
        return [(np.log(p[pieces.get(word[:k], -1), 0]) + lp, (pieces.get(word[:k], -1), *rest)) for k in range(1, min(3, len(word)) + 1) if word[:k] in pieces or k == 1 for lp, rest in segmentations(word[k:])]

    for word in ("abb", "cabab"):
        every = segmentations("▁" + word)
        total = np.logaddexp.reduce([lp for lp, _ in every])
        expected = np.zeros(len(p))
        for lp, used in every:
            np.add.at(expected, list(used), np.exp(lp - total))
        assert np.allclose(langid.expected_counts(lattice, [word], np.array([0]), np.array([1.0]), p)[:, 0], expected)


def test_words_of_any_length():
    """A plain dynamic program in logarithms, on words of 60 and 5000 letters."""
    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "bb": 5}
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 1e-7], [0.15, 0.2], [0.05, 0.1], [0.2, 0.3], [1e-9, 1e-9]])
    lattice, rng = langid.Lattice(pieces), random.Random(1)
    words = ["".join(rng.choices("abc", k=k)) for k in (60, 60, 3, 5000, 31, 30)]
    for lang in (0, 1):
        truth = []
        for w in words:
            sums = [0.0] + [-np.inf] * (len(w) + 1)
            for end in range(1, len(w) + 2):
                for start in range(max(0, end - 2), end):
                    piece = pieces.get(("▁" + w)[start:end])
                    if piece is not None or end == start + 1:
                        sums[end] = np.logaddexp(sums[end], sums[start] + np.log(p[-1 if piece is None else piece, lang]))
            truth.append(sums[-1])
        assert np.allclose(langid.forward(lattice, words, p)[:, lang], truth, rtol=1e-9)
        n = langid.expected_counts(lattice, words, np.full(len(words), lang), np.ones(len(words)), p)
        sizes = np.array([2, 1, 2, 1, 1, 2, 1])
        assert np.allclose((n[:, lang] * sizes).sum(), sum(len(w) + 1 for w in words))


def test_nbest(spark, docs):
    searcher, rng = nbest.Searcher(3), random.Random(9)
    score = {t: searcher.pieces.score[i] for i, t in searcher.pieces.text.items()}

    def brute(text):
        best = [[0.0]]
        for end in range(1, len(text) + 1):
            own = [x + (score[text[a:end]] if text[a:end] in score else searcher.pieces.score[-1]) for a in range(end) if text[a:end] in score or a == end - 1 for x in best[a]]
            best.append(sorted(own, reverse=True)[:3])
        return best[-1]

    for _ in range(500):
        text = "".join(rng.choices("ab he,. é中", k=rng.randint(1, 12)))
        found = next(searcher.texts([text]))
        assert [s for s, _ in found] == brute("▁" + text.replace(" ", "▁")) and len({i for _, i in found}) == len(found)
    assert nbest.nbest(docs).filter("not round_trip").count() == 0
    back = nbest.decode(nbest.nbest(docs)).filter("rank = 1").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d.doc_id), d.text or "") for d in docs.collect())


def test_token_counts_and_cache(spark, docs):
    path, library = scratch(spark, "cache-test"), segments.piece_library()
    first = counts.token_counts(docs, path).collect()
    assert sorted(map(str, first)) == sorted(map(str, counts.token_counts(docs, path).collect()))
    assert spark.read.parquet(path).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()  # the second call encoded nothing
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in first) == sorted((str(d.doc_id), len((d.text or "").encode()), len(library.encode(d.text or ""))) for d in docs.collect())


def test_near_duplicates(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for group in range(12):
        base = [word() for _ in range(300)]
        for copy in range(1 + group % 4 * 12):
            own = list(base)
            if copy:
                own[rng.randrange(300)] = word()
            texts.append((group, " ".join(own)))
    rows = [(k, t, "en", "s", 1) for k, (_, t) in enumerate(texts)] + [(1000, None, "", "", 0), (1001, "", "", "", 0), (1002, "a b", "", "", 0), (0, texts[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = minhash.classes(docs).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r.class_id for r in found}
    first = {}
    for k, (group, _) in enumerate(texts):
        assert of[k] == first.setdefault(group, k)
    assert of[1000] == of[1001] == 1000 and of[1002] == 1002
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted({*first.values(), 1000, 1002})
    assert minhash.classes(docs.limit(0)).count() == 0


def test_imatch(spark):
    rng = random.Random(12)
    rows = [(k * 3, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 80)))) for k in range(60)] + [(500, None), (500, "z"), (501, "é" * 7), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -math.inf), r[1]))
    follow = sorted((str(k), t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in imatch.with_next(docs, ["text"]).collect()) == follow
    one = docs.limit(1)
    assert [r.text == r.next_text for r in imatch.with_next(one, ["text"]).collect()] == [True]
    kept = imatch.lexicon(docs)
    prints = docs.union(docs).withColumn("p", imatch.fingerprint("text", kept)).groupBy("text").agg(F.count_distinct("p").alias("n")).filter("n > 1")
    assert prints.count() == 0 and imatch.with_next(docs.limit(0), ["text"]).count() == 0


def test_imatch_shuffles_texts_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = {"print": imatch.fingerprint("text", imatch.lexicon(docs))}
    moved, beside = imatch.with_next(docs.withColumns(made), ["text", "print"]), imatch.with_next(docs, ["text"], made)
    assert sorted(map(str, moved.select(*sorted(moved.columns)).collect())) == sorted(map(str, beside.select(*sorted(moved.columns)).collect()))
    from tessera.llm.registry import QUERIES

    plan = QUERIES["op10_imatch"](spark, small)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("- Exchange hashpartitioning(range")
    assert above.count("- Window [") == 2 and above.count("- Sort [") == 1 and " AS print#" in above and below and "Exchange hashpartitioning" not in below


def test_queries_run(spark, small):
    from tessera.llm.registry import QUERIES

    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    rows = QUERIES["op10_imatch"](spark, small).collect()
    texts = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    for i, (doc, text) in enumerate(texts):
        half, after = len(text) // 2, texts[(i + 1) % len(texts)][1]
        assert next(r for r in rows if r.doc_id == doc).edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    kept = {r.doc_id for r in out}
    words = lambda t: tuple(re.findall(r"\w+", t.lower()))
    assert kept <= set(docs) and {words(docs[k]) for k in docs if words(docs[k])} >= {words(docs[k]) for k in kept}
    assert len({words(docs[k]) for k in kept}) == len(kept)  # no exact copies stay
